"""netCDF classic files (CDF-1, CDF-2 and CDF-5) as fields (t, node, value), by a Python data source.

``read`` plans a partition for each range of time steps of each file, and filters on ``t`` become ranges of steps before
any value is read. A folder of files is one field: files go by name, and time goes on from one to the next (or starts at a
file's attribute ``first_record``). The first dimension of the variable is time; the others, flattened, are the nodes.
Missing values (attributes ``_FillValue`` and ``missing_value``, or the type's default fill, and NaN) are null;
``scale_factor`` and ``add_offset`` apply. A variable without the record dimension (an axis) is read from the first file.

``write`` deals the field in ranges of time; each task writes one file of its own steps, step by step, so it holds one step
in memory; files get their final names when all tasks are done. Cells without a row, and null values, hold the fill value;
steps without any row, between the first and the last of a file, as well.

Files are opened by ``pyarrow.fs``, from a path or URI of any store that it knows; the package must be on the executors.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the format: tags, and for each type its number, numpy's name for its big-endian values and its default fill.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
STREAMING = 0xFFFFFFFF
TYPES = {1: ("i1", -127), 2: ("S1", 0), 3: (">i2", -32767), 4: (">i4", -2147483647), 5: (">f4", 9.969209968386869e36), 6: (">f8", 9.969209968386869e36), 7: ("u1", 255), 8: (">u2", 65535), 9: (">u4", 4294967295), 10: (">i8", -9223372036854775806), 11: (">u8", 18446744073709551614)}
DOUBLE, VERSION = 6, 2  # of what is written
SCHEMA = "t long, node long, value double"
FIRST = "first_record"


@dataclass
class Variable:
    dims: list[int]
    attributes: dict
    kind: int
    begin: int


@dataclass
class Header:
    version: int
    records: int
    dims: list[tuple[str, int]] = field(default_factory=list)  # length 0: the record dimension
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)

    def of_records(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def cells(self, v: Variable) -> int:
        """Values of one step (of the whole, for a variable without dimensions)."""
        return int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64))

    def step(self, v: Variable) -> int:
        """Bytes of one step."""
        return self.cells(v) * np.dtype(TYPES[v.kind][0]).itemsize

    def stride(self, v: Variable) -> int:
        """Bytes from one step to the next: of all record variables, each padded to four, but a single one is not."""
        if not self.of_records(v):
            return self.step(v)
        sizes = [self.step(x) for x in self.variables.values() if self.of_records(x)]
        return sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)

    def steps(self, v: Variable, file_size: int) -> int:
        if not self.of_records(v):
            return self.dims[v.dims[0]][1] if v.dims else 1
        if self.records != STREAMING:
            return self.records
        begin = min(x.begin for x in self.variables.values() if self.of_records(x))
        return (file_size - begin) // max(1, self.stride(v))


def opened(path: str) -> tuple[store.FileSystem, str]:
    return store.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (store.LocalFileSystem(), path)


def read_header(f) -> Header:
    """The header of an open file, read front to back."""

    def number(code: str = ">I") -> int:
        return struct.unpack(code, f.read(struct.calcsize(code)))[0]

    def padded(n: int) -> bytes:
        raw = f.read(-(-n // 4) * 4)
        return raw[:n]

    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a netCDF classic file")
    version = magic[3]
    count = ">Q" if version == 5 else ">I"

    def listed(tag: int, item) -> list:
        got, n = number(), number(count)
        if got not in (0, tag) or got == 0 and n:
            raise ValueError(f"a list of kind {got} where {tag} belongs")
        return [item() for _ in range(n)]

    def name() -> str:
        return padded(number(count)).decode()

    def attribute() -> tuple[str, object]:
        key, kind, n = name(), number(), number(count)
        code = TYPES[kind][0]
        raw = padded(n * np.dtype(code).itemsize)
        return key, raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, code).tolist()

    def variable() -> tuple[str, Variable]:
        key = name()
        dims = [number(count) for _ in range(number(count))]
        attributes = dict(listed(ATTRIBUTE, attribute))
        kind = number()
        number(count)  # a size that is not to be trusted for large variables
        return key, Variable(dims, attributes, kind, number(">I" if version == 1 else ">Q"))

    records = number(count)
    header = Header(version, STREAMING if records == (1 << (64 if version == 5 else 32)) - 1 else records)
    header.dims = listed(DIMENSION, lambda: (name(), number(count)))
    header.attributes = dict(listed(ATTRIBUTE, attribute))
    header.variables = dict(listed(VARIABLE, variable))
    return header


def header_bytes(header: Header) -> bytes:
    """The header as CDF-2 with ``begin`` of all variables set: fixed ones first, in their order."""

    def packed(raw: bytes) -> bytes:
        return raw + b"\0" * (-len(raw) % 4)

    def named(key: str) -> bytes:
        raw = key.encode()
        return struct.pack(">I", len(raw)) + packed(raw)

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">II", tag if items else 0, len(items)) + b"".join(items)

    def attribute(key: str, value) -> bytes:
        if isinstance(value, str):
            return named(key) + struct.pack(">II", 2, len(value.encode())) + packed(value.encode())
        kind = DOUBLE if isinstance(value[0], float) else 4
        raw = np.array(value, TYPES[kind][0]).tobytes()
        return named(key) + struct.pack(">II", kind, len(value)) + packed(raw)

    def whole() -> bytes:
        dims = listed(DIMENSION, [named(k) + struct.pack(">I", n) for k, n in header.dims])
        variables = []
        for key, v in header.variables.items():
            size = min(-(-header.step(v) * (1 if header.of_records(v) or not v.dims else header.dims[v.dims[0]][1]) // 4) * 4, STREAMING)
            variables.append(named(key) + struct.pack(f">I{len(v.dims)}I", len(v.dims), *v.dims) + listed(ATTRIBUTE, [attribute(*x) for x in v.attributes.items()]) + struct.pack(">IIQ", v.kind, size, v.begin))
        return b"CDF\x02" + struct.pack(">I", header.records) + dims + listed(ATTRIBUTE, [attribute(*x) for x in header.attributes.items()]) + listed(VARIABLE, variables)

    at = len(whole())
    for records in (False, True):
        for v in header.variables.values():
            if header.of_records(v) == records:
                v.begin = at
                at += -(-header.step(v) * (1 if records or not v.dims else header.dims[v.dims[0]][1]) // 4) * 4
    return whole()


@dataclass
class Steps(InputPartition):
    """Steps a to b of a file; the first one is ``t`` in the whole field."""

    path: str
    a: int
    b: int
    t: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options.get("variable")
        self.bytes = int(options.get("bytes", 64 << 20))
        self.low, self.high = -(1 << 62), 1 << 62  # of t, both ends included

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of t become bounds of steps; lists of t as well, but these are looked at again."""
        for f in filters:
            whole = getattr(f, "attribute", None) == ("t",) and isinstance(getattr(f, "value", None), int)
            if whole and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif whole and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif whole and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif isinstance(f, IsNotNull) and f.attribute in (("t",), ("node",)):
                continue  # these never are
            else:
                if isinstance(f, In) and f.attribute == ("t",) and f.value and all(isinstance(v, int) for v in f.value):
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
                yield f

    def files(self) -> list[tuple[str, Header, Variable, int]]:
        """(path, header, variable, steps) of each file, by name."""
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        if info.type == store.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == store.FileType.File else [x for x in fs.get_file_info(store.FileSelector(path)) if x.type == store.FileType.File and not x.base_name.startswith((".", "_"))]
        out = []
        for x in sorted(found, key=lambda x: x.path):
            with fs.open_input_stream(x.path) as f:
                header = read_header(f)
            name = self.variable or next((k for k, v in header.variables.items() if len(v.dims) > 1), None)
            if name not in header.variables:
                raise ValueError(f"{x.path} has {', '.join(header.variables) or 'no variables'}, not {name}")
            v = header.variables[name]
            out.append((x.path, header, v, header.steps(v, x.size)))
            if not header.of_records(v):
                break
        return out

    def partitions(self) -> list[InputPartition]:
        out, t = [], 0
        for path, header, v, n in self.files():
            t = int(header.attributes.get(FIRST, [t])[0]) if header.of_records(v) else t
            a, b = max(0, self.low - t), min(n, self.high - t + 1)
            size = max(1, self.bytes // max(1, header.step(v)))
            out += [Steps(path, k, min(b, k + size), t + k) for k in range(a, b, size)]
            t += n
        return out or [Steps("", 0, 0, 0)]

    def read(self, partition: Steps, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        if partition.a >= partition.b:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as f:
            header = read_header(f)
            v = header.variables[self.variable or next(k for k, x in header.variables.items() if len(x.dims) > 1)]
            code, fill = TYPES[v.kind]
            missing = [m for key in ("_FillValue", "missing_value") for m in v.attributes.get(key, [])] or [fill]
            scale, offset = (v.attributes.get(key, [plain])[0] for key, plain in (("scale_factor", 1.0), ("add_offset", 0.0)))
            cells, width, stride = header.cells(v), np.dtype(code).itemsize, header.stride(v)
            for k in range(partition.a, partition.b):
                for c in range(0, cells, most):
                    n = min(most, cells - c)
                    f.seek(v.begin + k * stride + c * width)
                    raw = np.frombuffer(f.read(n * width), code)
                    if len(raw) < n:
                        raise ValueError(f"{partition.path} ends within step {k}")
                    gone = np.isin(raw, np.array(missing).astype(code)) | (np.isnan(raw) if raw.dtype.kind == "f" else False)
                    value = raw.astype(float)
                    value = value * scale + offset if (scale, offset) != (1.0, 0.0) else value
                    t = np.full(n, partition.t + k - partition.a)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.arange(c, c + n)), pa.array(value, mask=gone)], names=["t", "node", "value"])


@dataclass
class Written(WriterCommitMessage):
    file: str
    first: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.variable, self.fill = options["path"], options.get("variable", "value"), float(options.get("fill", TYPES[DOUBLE][1]))
        self.dims = [(name, int(n)) for name, _, n in (x.partition(":") for x in options["dims"].split(","))]
        if overwrite:
            fs, path = opened(self.path)
            if fs.get_file_info(path).type != store.FileType.NotFound:
                fs.delete_dir_contents(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file from rows in the order of t."""
        fs, path = opened(self.path)
        cells = int(np.prod([n for _, n in self.dims], dtype=np.int64))
        fs.create_dir(path)
        name, f, first, now, step = f".part-{uuid.uuid4().hex}", None, 0, 0, np.full(cells, self.fill, ">f8")

        def flush() -> None:
            f.write(struct.pack(">d", now))
            f.write(step.tobytes())
            step.fill(self.fill)

        for batch in iterator:
            t, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            value = np.where(np.asarray(batch.column(2).is_null()), self.fill, batch.column(2).to_numpy(zero_copy_only=False).astype(float))
            if len(t) and ((node < 0) | (node >= cells)).any():
                raise ValueError(f"nodes beyond the {cells} of {self.dims}")
            for own in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t)) + 1) if len(t) else []:
                if f is None:
                    first = now = int(t[own[0]])
                    header = Header(VERSION, STREAMING, [("time", 0), *self.dims], {FIRST: [float(first)]})
                    header.variables = {"time": Variable([0], {}, DOUBLE, 0), self.variable: Variable(list(range(len(self.dims) + 1)), {"_FillValue": [self.fill]}, DOUBLE, 0)}
                    f = fs.open_output_stream(f"{path}/{name}")
                    f.write(header_bytes(header))
                if t[own[0]] < now:
                    raise ValueError("rows out of the order of t")
                while now < t[own[0]]:
                    flush()
                    now += 1
                step[node[own]] = value[own]
        if f is None:
            return Written("", 0)
        flush()
        f.close()
        return Written(name, first)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.path)
        for k, m in enumerate(sorted((m for m in messages if m and m.file), key=lambda m: m.first)):
            fs.move(posixpath.join(path, m.file), posixpath.join(path, f"part-{k:06d}.nc"))

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(posixpath.join(path, m.file))


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read(spark: SparkSession, path: str, variable: str | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """(t, node, value) of a variable, by default the first of two dimensions or more."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfSource)
    reader = spark.read.format("netcdf").option("bytes", partition_bytes)
    return (reader.option("variable", variable) if variable else reader).load(path)


def read_axis(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(k, value) of a variable of one dimension."""
    return read(spark, path, variable).selectExpr("t AS k", "value")


def write(field: DataFrame, path: str, dims: dict[str, int], variable: str = "value", fill: float | None = None, partitions: int | None = None) -> None:
    """A field (t, node, value) as a folder of files whose nodes have the shape ``dims``."""
    field.sparkSession.dataSource.register(NetcdfSource)
    rows = field.selectExpr("CAST(t AS BIGINT) AS t", "CAST(node AS BIGINT) AS node", "CAST(value AS DOUBLE) AS value")
    dealt = (rows.repartitionByRange(partitions, "t") if partitions else rows.repartitionByRange("t")).sortWithinPartitions("t", "node")
    out = dealt.write.format("netcdf").option("dims", ",".join(f"{k}:{n}" for k, n in dims.items())).option("variable", variable)
    (out.option("fill", fill) if fill is not None else out).mode("overwrite").save(path)
