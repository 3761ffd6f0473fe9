"""The netCDF source: files made byte by byte, filters that reach the reader, round trips."""

import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from tidelens.sources import netcdf as nc


def named(text):
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def attribute(name, kind, values):
    code = {2: None, 3: ">i2", 5: ">f4", 6: ">f8"}[kind]
    raw = values.encode() if kind == 2 else np.array(values, code).tobytes()
    return named(name) + struct.pack(">II", kind, len(values)) + raw + b"\0" * (-len(raw) % 4)


def some_list(tag, items):
    return struct.pack(">II", tag if items else 0, len(items)) + b"".join(items)


def fixed_file(path):
    """CDF-1 of fixed dimensions: packed shorts (time, lat, lon) with a missing value, and an axis."""
    values = np.arange(3 * 2 * 4).reshape(3, 2, 4).astype(">i2")
    values[1, 0, 2] = -99
    values[2, 1, 3] = -32767
    lat = np.array([-10.0, 10.0], ">f4")

    def head(a, b):
        dims = some_list(10, [named("time") + struct.pack(">I", 3), named("lat") + struct.pack(">I", 2), named("lon") + struct.pack(">I", 4)])
        packed = some_list(12, [attribute("scale_factor", 6, [0.5]), attribute("add_offset", 6, [100.0]), attribute("missing_value", 3, [-99]), attribute("_FillValue", 3, [-32767]), attribute("units", 2, "K")])
        variables = [named("lat") + struct.pack(">II", 1, 1) + some_list(12, []) + struct.pack(">III", 5, 8, a), named("sst") + struct.pack(">IIII", 3, 0, 1, 2) + packed + struct.pack(">III", 3, 48, b)]
        return b"CDF\x01" + struct.pack(">I", 0) + dims + some_list(12, [attribute("title", 2, "a title")]) + some_list(11, variables)

    size = len(head(0, 0))
    path.write_bytes(head(size, size + 8) + lat.tobytes() + values.tobytes())
    return values


def test_fixed_dimensions(spark, tmp_path):
    values = fixed_file(tmp_path / "a.nc")
    rows = nc.read(spark, str(tmp_path / "a.nc"), "sst", partition_bytes=16)
    assert rows.rdd.getNumPartitions() == 3
    got = {(r.t, r.node): r.value for r in rows.collect()}
    want = {(t, 4 * y + x): None if values[t, y, x] in (-99, -32767) else values[t, y, x] * 0.5 + 100 for t in range(3) for y in range(2) for x in range(4)}
    assert got == want and sum(v is None for v in want.values()) == 2
    assert nc.read(spark, (tmp_path / "a.nc").as_uri()).count() == 24  # the first variable of several dimensions
    assert [(r.k, r.value) for r in nc.read_axis(spark, str(tmp_path / "a.nc"), "lat").collect()] == [(0, -10.0), (1, 10.0)]
    with pytest.raises(Exception, match="not wind"):
        nc.read(spark, str(tmp_path / "a.nc"), "wind").count()
    (tmp_path / "b.nc").write_bytes(b"HDF....")
    with pytest.raises(Exception, match="not a netCDF classic file"):
        nc.read(spark, str(tmp_path / "b.nc")).count()


def test_records_of_one_short_variable_and_cdf5(tmp_path):
    """A single record variable is not padded between its records; CDF-5 has 64-bit counts."""
    count = lambda n: struct.pack(">Q", n)
    long_name = lambda s: count(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    values = np.arange(9, dtype=">i2").reshape(3, 3)

    def head(begin):
        dims = struct.pack(">I", 10) + count(2) + long_name("time") + count(0) + long_name("x") + count(3)
        variable = long_name("v") + count(2) + count(0) + count(1) + struct.pack(">I", 0) + count(0) + struct.pack(">I", 3) + count(8) + count(begin)
        return b"CDF\x05" + count(3) + dims + struct.pack(">I", 0) + count(0) + struct.pack(">I", 11) + count(1) + variable

    (tmp_path / "c.nc").write_bytes(head(len(head(0))) + values.tobytes())
    reader = nc.Reader({"path": str(tmp_path / "c.nc"), "bytes": "6"})
    parts = reader.partitions()
    assert [(p.a, p.b, p.t) for p in parts] == [(0, 1, 0), (1, 2, 1), (2, 3, 2)]
    got = [b.column(2).to_pylist() for p in parts for b in reader.read(p)]
    assert got == values.astype(float).tolist()
    assert [b.column(1).to_pylist() for p in parts[:1] for b in reader.read(p, most=2)] == [[0, 1], [2]]


def test_round_trip_with_gaps(spark, tmp_path):
    rows = [(t, n, None if (t + n) % 7 == 0 else t + n / 8) for t in range(-2, 40) for n in range(6) if t % 11 != 3 and (t, n) != (5, 5)]
    nc.write(spark.createDataFrame(rows, "t long, node long, value double"), str(tmp_path / "f"), {"lat": 2, "lon": 3}, variable="sst", fill=-1e30, partitions=4)
    files = sorted(p.name for p in (tmp_path / "f").iterdir() if not p.name.startswith("."))
    assert len(files) == 4 and files[0] == "part-000000.nc"
    back = nc.read(spark, str(tmp_path / "f"), "sst", partition_bytes=480)
    given = {(t, n): v for t, n, v in rows}
    got = {(r.t, r.node): r.value for r in back.collect()}
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in given.items() if v is not None}
    assert all(got[k] is None for k in given if given[k] is None) and (5, 5) in got and back.rdd.getNumPartitions() > 4
    nc.write(spark.createDataFrame([(0, 0, 1.5)], "t long, node long, value double"), str(tmp_path / "f"), {"x": 1})
    assert [tuple(r) for r in nc.read(spark, str(tmp_path / "f")).collect()] == [(0, 0, 1.5)]  # the old files are gone


def test_filters_reach_the_reader(spark, tmp_path):
    rows = [(t, n, float(t * n)) for t in range(100) for n in range(4)]
    nc.write(spark.createDataFrame(rows, "t long, node long, value double"), str(tmp_path / "f"), {"x": 4}, partitions=3)

    def steps(*filters):
        reader = nc.Reader({"path": str(tmp_path / "f"), "bytes": "320"})
        rest = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        assert {t for p in parts for b in reader.read(p) for t in b.column(0).to_pylist()} == {p.t + k for p in parts for k in range(p.b - p.a)}
        return sum(p.b - p.a for p in parts), rest

    t = ("t",)
    assert steps()[0] == 100
    assert steps(GreaterThanOrEqual(t, 10), LessThan(t, 20)) == (10, [])
    assert steps(GreaterThan(t, 97), LessThanOrEqual(t, 500)) == (2, [])
    assert steps(EqualTo(t, 34)) == (1, []) and steps(EqualTo(t, 340)) == (0, [])
    some = In(t, (5, 9))
    assert steps(some, IsNotNull(t), EqualTo(("node",), 1)) == (5, [some, EqualTo(("node",), 1)])
    got = nc.read(spark, str(tmp_path / "f")).filter("t between 40 and 44 and node = 3 and value > 0")
    assert Counter(tuple(r) for r in got.collect()) == Counter((k, 3, float(3 * k)) for k in range(40, 45))
    assert got.rdd.getNumPartitions() == 1


def test_driver(spark, tmp_path):
    from tidelens.__main__ import main
    from tidelens.operators import resample as rs

    rng = np.random.default_rng(1)
    field = spark.createDataFrame([(t, n, float(rng.standard_normal())) for t in range(60) for n in range(3)], "t long, node long, value double")
    nc.write(field, str(tmp_path / "f"), {"x": 3}, variable="sst")
    main(["significance", str(tmp_path / "f"), str(tmp_path / "out"), "--variable", "sst", "--samples", "20", "--seed", "3"])
    want = {(r.i, r.j): r for r in rs.p_values(field, 20, 3).collect()}
    for name in ("pval", "estim", "lopt"):
        lines = [r.value.split() for r in spark.read.text(f"{tmp_path}/out/{name}.txt").collect()]
        assert [(int(a), int(b)) for a, b, _ in lines] == [(i, j) for i in range(3) for j in range(3)]
        for a, b, x in lines:
            i, j = sorted((int(a), int(b)))
            value = {"pval": 0.0, "estim": 1.0, "lopt": 0.0}[name] if i == j else {"pval": want[i, j].p, "estim": want[i, j].estim, "lopt": want[i, j].l}[name]
            assert abs(float(x) - value) < 1e-6
