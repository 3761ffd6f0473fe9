"""Algebraic invariants and small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.operators import dynamics as dy
from tidelens.operators import markov as mk
from tidelens.operators import matrix as mx
from tidelens.operators import network as nw
from tidelens.operators import phase as ph
from tidelens.operators import resample as rs
from tidelens.operators import spectral as sp
from tidelens.operators import timeseries as ts
from tidelens.operators.partition import greedy_codelength, two_level_codelength
from tidelens.sources import text as tx


@pytest.fixture(scope="module")
def dense():
    return np.random.default_rng(3).random((6, 6)) + 0.1


def frame(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1]) if m[i, j]], "i long, j long, w double")


def vector(spark, p):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(p)], "node long, p double")


def array(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] += r.w
    return out


def stationary(t):
    w, v = np.linalg.eig(t.T)
    p = np.abs(v[:, np.argmax(w.real)].real)
    return p / p.sum()


def test_stochastic(spark, dense):
    m = frame(spark, dense)
    assert np.allclose(array(mx.stochastic(m, "i"), 6).sum(axis=1), 1)
    assert np.allclose(array(mx.stochastic(m, "j"), 6).sum(axis=0), 1)
    assert np.isclose(array(mx.stochastic(m, "all"), 6).sum(), 1)
    zero = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0)], "i long, j long, w double")
    assert sorted(r.w for r in mx.stochastic(zero, "i").collect()) == [-1.0, 1.0]


def test_products(spark, dense):
    m = frame(spark, dense)
    assert np.allclose(array(mx.product(m, mx.transposed(m)), 6), dense @ dense.T)
    got = {r.node: r.p for r in mx.vector_product(vector(spark, range(6)), m).collect()}
    assert np.allclose([got[k] for k in range(6)], np.arange(6) @ dense)


def test_lumping_and_reversal(spark, dense):
    t = dense / dense.sum(axis=1, keepdims=True)
    p = stationary(t)
    m, v = frame(spark, t), vector(spark, p)
    members = spark.createDataFrame([(k, k % 2 + 1) for k in range(6)], "node long, com long")
    r = array(mk.lumped(m, members, v).withColumn("i", F.col("i") - 1).withColumn("j", F.col("j") - 1), 2)
    assert np.allclose(r.sum(axis=1), 1)
    flow = array(mk.community_flow(mk.node_flow(m, v), members).withColumn("i", F.col("i") - 1).withColumn("j", F.col("j") - 1), 2)
    assert np.isclose(flow.sum(), 1)
    a = array(mk.additive_reversible(m, v), 6)
    assert np.allclose(p[:, None] * a, (p[:, None] * a).T)  # detailed balance
    s = array(mk.symmetrised(m, v), 6)
    assert np.allclose(s, np.sqrt(p)[:, None] * t.T / np.sqrt(p)[None])
    fuzzy = spark.createDataFrame([(k, c, 1.0 if c == k % 2 else 0.0) for k in range(6) for c in range(2)], "i long, j long, w double")
    assert np.allclose(array(mk.fuzzy_lumped(m, fuzzy, v), 2), r)


def test_rank(spark, dense):
    t = dense / dense.sum(axis=1, keepdims=True)
    got = {r.node: r.p for r in mk.pagerank(frame(spark, dense), spark.range(6).toDF("node"), tol=1e-10, max_iter=40).collect()}
    assert np.allclose([got[k] for k in range(6)], stationary(t), atol=1e-6)


def test_codelength(spark, dense):
    t = dense / dense.sum(axis=1, keepdims=True)
    p = stationary(t)
    members = spark.createDataFrame([(k, k // 3 + 1) for k in range(6)], "node long, com long")
    r = two_level_codelength(frame(spark, t), members, vector(spark, p)).first()
    assert math.isclose(r.l, r.hu - r.hq + r.hqm)
    weighted = two_level_codelength(frame(spark, t), members, vector(spark, p), weighted=True).first()
    steps = greedy_codelength(frame(spark, t), vector(spark, p)).toPandas()
    assert steps.step.max() == 5 and steps[steps.step == 5].com.nunique() == 1
    assert steps[steps.step == 0].com.nunique() == 6
    assert math.isclose(steps[steps.step == 5].l.iloc[0], -(p * np.log2(p)).sum(), abs_tol=1e-9)  # one module: H(Q) = h(Q) = 0
    assert weighted.l > 0


def test_closeness_and_peeling(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 5.0), (2, 0, 1.0)], "i long, j long, w double")
    got = {r.node: r.c for r in nw.closeness(edges, spark.range(4).toDF("node")).collect()}
    assert math.isclose(got[0], 4 / (1 + 3 + 4)) and math.isclose(got[3], 4 / 12)
    clique = [(a, b, 1.0) for a in range(4) for b in range(a)] + [(4, 0, 1.0)]
    members = spark.createDataFrame([(k, 1) for k in range(5)], "node long, com long")
    kept = nw.peeled(spark.createDataFrame(clique, "i long, j long, w double"), members, 0.9).collect()
    assert sorted(r.node for r in kept) == [0, 1, 2, 3]


def test_similarity_blocks(spark):
    x = np.random.default_rng(1).random((40, 8))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(90, [1.0] * 8), (91, None)], "node long, vec array<double>")
    got = {(r.i, r.j): r.w for r in nw.similarity_blocks(rows, block=9).collect()}
    want = np.corrcoef(x)
    assert len(got) == 40 * 39 // 2
    assert all(math.isclose(w, want[i, j], abs_tol=1e-12) for (i, j), w in got.items())


def test_series(spark):
    x = np.random.default_rng(2).random(60)
    f = spark.createDataFrame([(k, 0, float(v)) for k, v in enumerate(x)], "t long, node long, value double")
    assert math.isclose(ts.lag_autocorrelation(f, 3).first().a, np.corrcoef(x[:-3], x[3:])[0, 1])
    flat = f.withColumn("value", F.lit(1.0))
    assert ts.lag_autocorrelation(flat).first().a is None
    c = {r.lag: r.c for r in ts.ccf(f, f, 5).collect()}
    assert math.isclose(c[0], 1) and math.isclose(c[-4], c[4])
    perio = sp.periodogram(f.filter("t < 32"), 32).orderBy("k").toPandas()
    assert math.isclose(perio.power.iloc[0] + perio.power.iloc[-1] + 2 * perio.power.iloc[1:-1].sum(), 1)
    windowed = (x[:32] - x[:32].mean()) * np.hamming(32)
    power = np.abs(np.fft.rfft(windowed)) ** 2
    assert np.allclose(perio.power, power / (np.abs(np.fft.fft(windowed)) ** 2).sum())


def test_modes(spark):
    x = np.random.default_rng(4).random((50, 4)) @ np.diag([5, 2, 1, 0.5])
    f = spark.createDataFrame([(t, k, float(x[t, k])) for t in range(50) for k in range(4)], "t long, node long, value double")
    modes = sp.eof(f)
    got = modes.orderBy("mode", "node").toPandas()
    w, v = np.linalg.eigh(np.cov(x.T, ddof=0))
    assert np.allclose(got.eigenvalue.to_numpy().reshape(4, 4)[:, 0], w[::-1])
    pc = sp.principal_components(f, modes).toPandas().pivot(index="t", columns="mode", values="pc")
    assert np.allclose(pc.var(ddof=0), w[::-1])
    turned = sp.varimax(modes.filter("mode < 2")).toPandas()
    assert math.isclose((turned.loading**2).sum(), 2, rel_tol=1e-9)
    ev = sp.eigenvalues(frame(spark, np.array([[0.0, 1], [-1, 0]])), 2).orderBy("k").collect()
    assert [round(r.im, 9) for r in ev] == [1, -1]


def test_boxes(spark):
    bounds = {"x": [0.0, 1, 2, 3, 4, 5, 6, 7, 8, 9], "y": [0.0, 0.5, 4.0]}
    s = spark.createDataFrame([(0.0, 0.0), (8.999, 3.9), (9.0, 1.0), (1.0, 0.5), (float("nan"), 1.0), (None, 1.0)], "x double, y double")
    assert [r.mem for r in ph.boxed(s, bounds).collect()] == [0, 17, -1, 10, -1, -1]
    weights = vector(spark, [0.5, 0.3, 0.15, 0.05]).withColumnRenamed("node", "box")
    assert [r.level for r in ph.level_fill(weights, 1).orderBy("box").collect()] == [0, 1, 1, 1]


def test_resampling(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(80)
    y = x + 0.1 * rng.standard_normal(80)
    z = rng.standard_normal(80)
    f = spark.createDataFrame([(t, k, float(v[t])) for k, v in enumerate((x, y, z)) for t in range(80)], "t long, node long, value double")
    p = {(r.i, r.j): r.p for r in rs.p_values(f, 40, seed=1).collect()}
    assert p[(0, 1)] == 0 and p[(0, 2)] > 0.01
    ci = {(r.i, r.j): r for r in rs.percentile_interval(f, 40, 0.1, seed=1).collect()}
    assert 0.9 < ci[(0, 1)].lo <= ci[(0, 1)].hi <= 1
    own = rs.bootstrap_set(f, 3, kind=lambda a, b: float((a * b).mean()))
    assert own.count() == 9
    short = f.filter("t < 3")
    assert {r.p for r in rs.p_values(short, 5, length=3).collect()} == {1.0}
    for method in ("normal", "student", "bca"):
        r = {(r.i, r.j): r for r in rs.intervals(f, 30, 0.1, method, fisher=method == "normal").collect()}[(0, 1)]
        assert 0.9 < r.lo <= r.hi <= 1.01
    assert abs(rs.student_quantile(0.975, 10) - 2.228139) < 1e-5


def test_generators(spark):
    start = spark.createDataFrame([(1, [1.0, 1.0, 20.0], [10.0, 28.0, 8 / 3])], "id long, state array<double>, params array<double>")
    got = dy.trajectories(start, "lorenz", 0.01, 5).orderBy("t").collect()
    s, p = np.array([[1.0, 1, 20]]), np.array([[10, 28, 8 / 3]])
    for _ in range(5):
        s = dy.rk4(dy.lorenz, s, p, 0.01)
    assert math.isclose(got[-1].x, s[0, 0]) and len(got) == 5
    noisy = start.withColumn("q", F.array(*[F.lit(0.1)] * 3))
    twice = [dy.trajectories(noisy, "lorenz", 0.01, 4, "euler", noise="linear", spinup=2, sampling=2, seed=9).collect() for _ in range(2)]
    assert twice[0] == twice[1] and len(twice[0]) == 2


def test_files(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.5), (2, 0, 1.0), (1, 1, 4.0)], "i long, j long, w double")
    want = sorted(map(tuple, m.collect()))
    tx.write_pajek(m, 3, f"{tmp_path}/p")
    assert sorted(map(tuple, tx.read_pajek(spark, f"{tmp_path}/p").collect())) == want
    for kind in ("CSR", "CSC"):
        tx.write_compressed(m, 3, 3, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, tx.read_compressed(spark, f"{tmp_path}/{kind}").collect())) == want
    (tmp_path / "plain.net").write_text('Vertices 2\n0 a\n1 b\nEdges 2\n0 1 0.5\n0 1 0.5\n')
    assert [tuple(r) for r in tx.read_pajek(spark, f"{tmp_path}/plain.net").collect()] == [(0, 1, 1.0)]
    (tmp_path / "t.tree").write_text('# Codelength 2.5 bits in 2 modules of 3 nodes\n1:1 0.5 "1"\n1:2 0.3 "3"\n2:1:1 0.2 "2"\n')
    tree = {(r.node, r.level): r.com for r in tx.read_tree(spark, f"{tmp_path}/t.tree").collect()}
    assert tree == {(0, 1): 1, (2, 1): 1, (1, 1): 2, (0, 2): 1, (2, 2): 2, (1, 2): 3, (0, 3): 1, (2, 3): 2, (1, 3): 3}
    assert tx.pretty(m, [0, 1, 2], 1).filter("i = 0").first().line == "---\t2.5\t---"


def test_convert(spark, tmp_path):
    from tidelens.__main__ import main

    m = spark.createDataFrame([(0, 1, 2.5), (2, 0, 1.0)], "i long, j long, w double")
    tx.write_compressed(m, 3, 3, f"{tmp_path}/c", "CSC")
    main(["convert", f"{tmp_path}/c", f"{tmp_path}/e"])
    assert sorted(map(tuple, tx.read_edges(spark, f"{tmp_path}/e", base=0).collect())) == [(0, 1, 2.5), (2, 0, 1.0)]


def test_forms_of_text(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.0), (2, 0, 1.5)], "i long, j long, w double")
    rows = {r.i: r.line for r in tx.pretty(m, [0, 1, 2], digits=1).collect()}
    assert rows == {0: "---\t2.0\t---", 2: "1.5\t---\t---"}
    tx.write_grid(spark, {"x": [0.0, 0.5], "y": [-1.0, 1.0, 3.0]}, str(tmp_path / "grid"))
    assert [r.value for r in spark.read.text(str(tmp_path / "grid")).collect()] == ["0.0\t0.5", "-1.0\t1.0\t3.0"]
    (tmp_path / "net").write_text("*Edges 2\n0 1 2\n1 2\n")  # no vertices: the base is given
    assert sorted((r.i, r.j, r.w) for r in tx.read_pajek(spark, str(tmp_path / "net"), base=0).collect()) == [(0, 1, 2.0), (1, 2, 1.0)]


def test_dense_rows_of_several_files(spark, tmp_path):
    rows = [" ".join(str(10 * i + j) for j in range(4)) for i in range(9)]
    spark.createDataFrame(list(enumerate(rows)), "k long, line string").repartitionByRange(3, "k").sortWithinPartitions("k").select("line").write.text(str(tmp_path / "dense"))
    got = {(r.i, r.j): r.w for r in tx.read_dense(spark, str(tmp_path / "dense")).collect()}
    assert got == {(i, j): float(10 * i + j) for i in range(9) for j in range(4)}


def test_paths_of_long_chains(spark):
    """Paths of more than 64 edges are found, and a cycle of negative weight is an error."""
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(80)], "i long, j long, w double")
    nodes = spark.createDataFrame([(k,) for k in range(81)], "node long")
    far = nw.shortest_paths(edges, nodes, sources=nodes.filter("node = 0"))
    assert {r.j: r.d for r in far.collect()} == {k: float(k) for k in range(81)}
    with pytest.raises(RuntimeError):
        nw.shortest_paths(spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "i long, j long, w double"), nodes.filter("node < 2"))


def test_density_without_pairs(spark):
    """Thresholds and densities from histograms equal those of all pairs."""
    x = np.random.default_rng(5).standard_normal((60, 12))
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "node long, vec array<double>")
    sim = nw.similarity_blocks(v, block=20).cache()
    for rho in (0.0, 0.1, 0.5, 0.99):
        want, got = nw.threshold_of_density(sim, rho).first(), nw.threshold_of_density_of(v, rho, block=20).first()
        assert (want[0] is None) == (got[0] is None) and (want[0] is None or abs(want[0] - got[0]) < 1e-12)
    want, got = ({r.bin: (r.threshold, r.density) for r in f.collect()} for f in (nw.edge_density(sim, 10), nw.edge_density_of(v, 10, block=20)))
    assert want.keys() == got.keys() and all(np.allclose(want[k], got[k]) for k in want)


def test_bootstrap_forms(spark):
    rng = np.random.default_rng(6)
    rows = [(t, n, float(v)) for n in range(3) for t, v in enumerate(rng.standard_normal(50))]
    field = spark.createDataFrame(rows, "t long, node long, value double")
    both = {(r.i, r.j) for r in rs.p_values(field, 10, length=5, other=field.filter("node < 2")).collect()}
    assert both == {(i, j) for i in range(3) for j in range(2)}
    auto = rs.bootstrap_set(field, 10, length=5, auto=True, paired=True).toPandas()
    assert set(zip(auto.i, auto.j, strict=True)) == {(k, k) for k in range(3)} and np.allclose(auto.s, 1)
    plain = rs.bootstrap_set(field, 300, length=5).toPandas().sort_values(["i", "j", "sample"])
    own = rs.bootstrap_set(field, 300, length=5, kind=lambda x, y: np.corrcoef(x, y)[0, 1]).toPandas().sort_values(["i", "j", "sample"])
    assert len(plain) == 900 and np.allclose(plain.s, own.s)
    normal = {(r.i, r.j): r.p for r in rs.p_values(field, 5, length=5, level="normal").collect()}
    student = {(r.i, r.j): r.p for r in rs.p_values(field, 5, length=5, level="student", df=60).collect()}
    assert all(0 < normal[k] < 0.5 + 1e-9 and abs(normal[k] - student[k]) < 5e-3 for k in normal)
    assert rs.surrogate_p_values(field, 5, "mbb", length=5).count() == rs.surrogate_p_values(field, 5, "phase").count() == 3
    values = spark.createDataFrame([(0, 1.0), (1, 3.0)], "node long, v double")
    assert [rs.pair_from_nodes(values, m).first().v for m in ("max", "min", "mean")] == [3.0, 1.0, 2.0]


def test_polar_rotation(spark):
    rng = np.random.default_rng(7)
    xy = rng.standard_normal((200, 2)) @ np.array([[2.0, 1.0], [0.0, 0.3]])
    states = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "t long, x double, y double")
    turned = ph.principal_axes(states, ("x", "y")).toPandas()
    assert abs(np.cov(turned.x, turned.y)[0, 1]) < 1e-9 and turned.x.var() > turned.y.var()
    got = ph.polar_membership(states, 1, 2, n=8, rotation="eof").toPandas().sort_values("t")
    assert list(got.columns) == ["t", "x", "y", "mem"] and np.allclose(got[["x", "y"]], xy) and got.mem.between(0, 3).all()


def test_storage_is_cleared(spark):
    from tidelens.functions import storage

    nodes = spark.createDataFrame([(k,) for k in range(6)], "node long")
    edges = spark.createDataFrame([(k, (k + 1) % 6, 1.0) for k in range(6)], "i long, j long, w double")
    before = len(storage.WRITTEN)
    nw.shortest_paths(edges, nodes).count()
    assert len(storage.WRITTEN) - before <= 3  # edges, numbers of the sources, and the last round
    storage.clear(spark)
    assert not storage.WRITTEN
