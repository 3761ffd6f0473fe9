"""Operators in rounds and by parts against plain numpy versions, at sizes that take more than one round or part."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.functions import ordering
from tidelens.operators import krylov
from tidelens.operators import network as nw
from tidelens.operators import partition as pt
from tidelens.operators import phase as ph
from tidelens.operators import spectral as sp
from tidelens.sources import text as tx


def frame_of(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, w double")


def test_places_and_running_sums(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, 500)
    rows = spark.createDataFrame([(k, int(v), float(v)) for k, v in enumerate(x)], "k long, v long, w double").repartition(4)
    got = sorted(map(tuple, ordering.placed(rows, F.desc("v"), "k", sums={"before": "w"}, partitions=7).collect()), key=lambda r: r[3])
    want = sorted(((k, int(v)) for k, v in enumerate(x)), key=lambda r: (-r[1], r[0]))
    assert [(r[0], r[1]) for r in got] == want and [r[3] for r in got] == list(range(500))
    assert np.allclose([r[4] for r in got], np.r_[0, np.cumsum([v for _, v in want])[:-1]])
    assert ordering.placed(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize("which", ["LM", "SR"])
def test_eigenvalues_in_cycles(spark, which):
    """A basis much smaller than the matrix, complex pairs among the wanted."""
    rng = np.random.default_rng(2)
    n = 160
    m = np.diag(rng.uniform(-0.3, 1, n) * (1 if which == "LM" else -1)) + 0.02 * rng.standard_normal((n, n)) * (rng.random((n, n)) < 0.1)
    for k, (a, b) in enumerate(((3.0, 2.0), (-3.5, 1.5), (-2.5, 0.5))):
        m[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = [[a, b], [-b, a]]
    w, vectors = krylov.leading(frame_of(spark, m), 4, which, block=4, most=32)
    want = np.linalg.eigvals(m)
    want = want[krylov.ordered(want, which)][:4]
    assert np.allclose(np.sort_complex(w), np.sort_complex(want), atol=1e-7)
    z = np.zeros((n, 4), complex)
    for r in vectors.collect():
        z[r.node, r.k] = r.re + 1j * r.im
    assert np.abs(m @ z - z * w).max() < 1e-7 and np.allclose(np.linalg.norm(z, axis=0), 1)


def test_left_eigenvectors_of_a_large_chain(spark):
    """6,000 states in three weakly linked groups, more than a dense matrix of the library may have."""
    n, groups = 6000, 3
    k = F.col("id")
    edges = spark.range(n).select(k.alias("i"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("s"))
    far = F.pmod(F.xxhash64("i", "s"), F.lit(n // groups))
    own = (F.pmod("i", F.lit(groups)) + far * groups) % n
    mat = edges.select("i", F.when(F.pmod(F.xxhash64("i", "s", F.lit(1)), F.lit(50)) == 0, (own + 1) % n).otherwise(own).alias("j"), F.lit(1.0).alias("w"))
    pairs = sp.left_eigenvectors(mat, 3, 0.99, most=40).persist()
    assert pairs.select("node").distinct().count() == n
    values = {r.k: complex(r.value_re, r.value_im) for r in pairs.select("k", "value_re", "value_im").distinct().collect()}
    assert abs(values[0] - 1) < 1e-9 and 0.5 < abs(values[1]) < 1
    assert all(r.residual < 1e-8 for r in sp.left_residuals(mat, pairs, 0.99).collect())
    assert pairs.filter("k = 0 and re < 0").count() == 0
    empty = mat.limit(0)
    assert sp.eigenvalues(empty, 3).count() == 0


@pytest.mark.parametrize(("nodes", "times"), [(70, 9), (8, 60)])
@pytest.mark.parametrize("correlation", [False, True])
def test_modes_of_either_shape(spark, nodes, times, correlation):
    rng = np.random.default_rng(nodes)
    x = rng.standard_normal((times, 3)) @ (rng.standard_normal((3, nodes)) * [[5], [2], [1]]) + 0.1 * rng.standard_normal((times, nodes)) + 7
    x[:, 1] = 4.0
    rows = [(t, n, float(x[t, n])) for t in range(times) for n in range(nodes) if (t, n) != (2, 3)] + [(2, 3, None)]
    x[2, 3] = np.delete(x[:, 3], 2).mean()
    field = spark.createDataFrame(rows, "t long, node long, value double").repartition(5)
    a = x - x.mean(axis=0)
    if correlation:
        size = np.array([np.delete(x[:, n], 2).std() if n == 3 else x[:, n].std() for n in range(nodes)])
        a = np.divide(a, size, out=np.zeros_like(a), where=size > 1e-12)
    w, v = np.linalg.eigh(a.T @ a / times)
    got = sp.eof(field, correlation, count=3, rows_of_block=4).toPandas()
    assert len(got) == 3 * nodes
    for mode in range(3):
        own = got[got["mode"] == mode].sort_values("node")
        assert np.allclose(own.eigenvalue, w[::-1][mode], rtol=1e-8)
        u = v[:, ::-1][:, mode]
        u = u * (1 if u[np.abs(u).argmax()] > 0 else -1)
        assert np.allclose(own.loading, u, atol=1e-6)
    assert sp.eof(field.limit(0)).count() == 0


def test_varimax_with_absent_loadings(spark):
    rng = np.random.default_rng(4)
    x = np.linalg.qr(rng.standard_normal((40, 3)))[0]
    x[5, 1] = 0
    rows = [(m + 2, n, float(x[n, m])) for n in range(40) for m in range(3) if (n, m) != (5, 1)]
    for normalise in (False, True):
        got = sp.varimax(spark.createDataFrame(rows, "mode long, node long, loading double"), normalise).toPandas()
        size = np.linalg.norm(x, axis=1, keepdims=True) if normalise else np.ones((40, 1))
        y, turn, last = x / size, np.eye(3), 0.0
        for _ in range(1000):
            b = y @ turn
            u, s, v = np.linalg.svd(y.T @ (b**3 - b * (b**2).mean(axis=0)))
            turn = u @ v
            if s.sum() < last * (1 + 1e-5):
                break
            last = s.sum()
        b = y @ turn * size
        b = b * np.where(b[np.abs(b).argmax(axis=0), range(3)] < 0, -1, 1)
        wide = got.pivot(index="node", columns="mode", values="loading").sort_index()
        assert list(wide.columns) == [2, 3, 4] and np.allclose(wide.to_numpy(), b, atol=1e-9)


def plog(x):
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0.0)


def test_merges_in_rounds(spark):
    """Many modules merge in one round, never linked ones, and gains add up to the code length of the final partition."""
    rng = np.random.default_rng(5)
    m = np.zeros((40, 40))
    for g in range(10):  # fours that are linked within, and in a ring between
        own = range(4 * g, 4 * g + 4)
        for i in own:
            for j in own:
                m[i, j] = rng.uniform(0.5, 1.5)
        m[4 * g, (4 * g + 4) % 40] = 0.05
    m[39, 37] = 0
    p = m.sum(axis=1) / m.sum()
    t = m / m.sum(axis=1, keepdims=True)
    merges, owners = pt.greedy_rounds(frame_of(spark, t), spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "node long, p double"))
    merges, owners = merges.toPandas(), owners.toPandas()
    assert (merges["round"] == 1).sum() > 3 and merges["round"].max() < 39 and len(merges) == 39
    flow = p[:, None] * t
    length = lambda f: 2 * plog(f.sum(axis=1)).sum() - plog(f).sum()
    for step in sorted(owners["step"].unique()):
        own = owners[owners["step"] == step].set_index("node")["module"]
        named = sorted(own.unique())
        at = np.array([named.index(own[k]) for k in range(40)])
        grouped = np.zeros((len(named), len(named)))
        np.add.at(grouped, (at[:, None], at[None]), flow)
        done = merges[merges["round"] <= step]["gain"].sum()
        assert abs(length(grouped) - length(flow) - done) < 1e-8
        assert all(own[k] <= k for k in range(40))  # named by the least node


def test_levels_of_equal_weights(spark):
    weights = spark.createDataFrame([(k, 1 / 16) for k in range(16)], "box long, p double")
    assert [r.level for r in ph.level_fill(weights, 3).orderBy("box").collect()] == [k // 4 for k in range(16)]
    few = spark.createDataFrame([(0, 0.9), (1, 0.06), (2, 0.04)], "box long, p double")
    assert [r.level for r in ph.level_fill(few, 1).orderBy("box").collect()] == [0, 1, 1]
    assert ph.level_fill(weights.limit(0), 2).count() == 0


def test_density_on_a_grid(spark):
    """Correlated states on 60 x 60 boxes, as by all pairs; the work does not depend on the number of states."""
    rng = np.random.default_rng(6)
    xy = rng.standard_normal((3000, 2)) @ np.array([[2.0, 0.0], [1.5, 0.4]]) + [5, -3]
    states = spark.createDataFrame([(float(a), float(b)) for a, b in xy] + [(None, 1.0)], "x double, y double")
    boxes = ph.box_centres(spark, ph.uniform_bounds({"x": (-3, 13, 60), "y": (-9, 3, 60)}))
    for bandwidth in (None, 0.05):
        got = ph.kde_weights(states, boxes, ["x", "y"], bandwidth).toPandas().set_index("box").p
        at = boxes.toPandas().set_index("box")
        inverse = np.linalg.inv(np.cov(xy.T) * (bandwidth or 3000 ** (-1 / 6)) ** 2)
        want = np.zeros(3600)
        for box, x, y in at[["x", "y"]].itertuples():
            d = np.array([x, y]) - xy
            want[box] = np.exp(-0.5 * np.einsum("ka,ab,kb->k", d, inverse, d)).sum()
        assert np.abs(got.sort_index().to_numpy() - want / want.sum()).max() < 1e-12
    one = ph.kde_weights(states, ph.box_centres(spark, {"x": [float(k) for k in range(-3, 14)]}), ["x"]).toPandas().sort_values("box").p
    d = (np.arange(-3, 13) + 0.5)[:, None] - xy[:, 0]
    want = np.exp(-0.5 * d**2 / (xy[:, 0].var(ddof=1) * 3000 ** (-2 / 5))).sum(axis=1)
    assert np.allclose(one, want / want.sum(), atol=1e-12)


def dijkstra(edges, source, n):
    near = {}
    for i, j, w in edges:
        near.setdefault(i, []).append((j, w))
    far, heap = {}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in far:
            far[v] = d
            for u, w in near.get(v, ()):
                heapq.heappush(heap, (d + w, u))
    return far


@pytest.mark.parametrize("delta", [None, 0.9])
def test_paths_by_steps(spark, delta):
    rng = np.random.default_rng(7)
    n = 40
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 160), rng.integers(0, n, 160), rng.uniform(0, 2, 160), strict=True)] + [(0, 1, 0.0)]
    mat, nodes = spark.createDataFrame(edges, "i long, j long, w double"), spark.createDataFrame([(k,) for k in range(n)], "node long")
    got = {(r.i, r.j): r.d for r in nw.shortest_paths(mat, nodes, delta=delta, block=20).collect()}
    want = {(s, v): d for s in range(n) for v, d in dijkstra(edges, s, n).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if delta is not None:
        return
    c = {r.node: r.c for r in nw.closeness(mat, nodes, block=20).collect()}
    for s in range(n):
        own = [d for (a, _), d in want.items() if a == s]
        assert math.isclose(c[s], n / (sum(own) + (n - len(own)) * n))


def test_pivots_leave_block_pairs_out(spark):
    """Series in groups: more than half of the block pairs are not multiplied, and no edge is lost."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 40))
    x = np.concatenate([b + 0.25 * rng.standard_normal((50, 40)) for b in base] + [-base[0] + 0.25 * rng.standard_normal((20, 40))])
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)] + [(700, [1.0] * 40), (701, None)], "node long, vec array<double>")
    _, pairs, every = nw.reaching_blocks(v, 0.7, 16, 25)
    kept = pairs.count()
    assert kept < 0.5 * every
    r = np.corrcoef(x)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if abs(r[i, j]) > 0.7}
    got = {(e.i, e.j): e.w for e in nw.pruned_similarity(v, 0.7, 16, 25).collect()}
    assert got.keys() == want and all(abs(got[i, j] - r[i, j]) < 1e-9 for i, j in want)
    assert nw.pruned_similarity(v.limit(0), 0.7).count() == 0


def test_compressed_arrays_in_slices(spark, tmp_path):
    rng = np.random.default_rng(9)
    m = rng.standard_normal((30, 20)) * (rng.random((30, 20)) < 0.3)
    m[7] = 0
    want = sorted((int(i), int(j), m[i, j]) for i, j in zip(*np.nonzero(m), strict=True))
    for kind in ("CSR", "CSC"):
        tx.write_compressed(frame_of(spark, m), 30, 20, f"{tmp_path}/{kind}", kind, slice_of=7)
        assert len([p for p in (tmp_path / kind).iterdir() if p.name.startswith("part-")]) >= 1
        whole = b"".join(p.read_bytes() for p in sorted((tmp_path / kind).glob("part-*"))).decode().split("\n")
        head, values, inner, outer = (line.split() for line in whole[:4])
        assert head == [kind, "30", "20", str(len(want))] and len(values) == len(inner) == len(want) and len(outer) == (31 if kind == "CSR" else 21)
        assert [int(x) for x in outer] == np.r_[0, np.cumsum((m != 0).sum(axis=1 if kind == "CSR" else 0))].tolist()
        got = sorted(map(tuple, tx.read_compressed(spark, f"{tmp_path}/{kind}").collect()))
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-15)
    (tmp_path / "plain").write_text("csr 2 3 2\n1.5 2\n2 0\n0 1 2\n")
    assert sorted(map(tuple, tx.read_compressed(spark, str(tmp_path / "plain")).collect())) == [(0, 2, 1.5), (1, 0, 2.0)]
    tx.write_compressed(frame_of(spark, np.zeros((2, 2))), 2, 2, f"{tmp_path}/none")
    assert tx.read_compressed(spark, f"{tmp_path}/none").count() == 0
