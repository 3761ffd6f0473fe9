"""All pairs of vectors: nothing is shuffled that grows with the pairs, and results are those of the whole matrix."""

import math

import numpy as np
import pytest

from tidelens.operators import network as nw


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(k), [float(a) for a in r]) for k, r in zip(range(len(x)) if ids is None else ids, x, strict=True)], "node long, vec array<double>")


def on_disk(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()))


CASES = {
    "pruned": lambda v: nw.correlation_edges(v, 0.4, block=6, pivots=4),
    "edges": lambda v: nw.correlation_edges(v, 0.4, block=6),
    "giant": lambda v: nw.correlation_edges(v, 0.4, block=6, giant=True),
    "similar": lambda v: nw.similarity_blocks(v, block=6, least=0.4),
    "density": lambda v: nw.edge_density_of(v, 50, digits=9, block=6),
    "threshold": lambda v: nw.threshold_of_density_of(v, 0.1, digits=9, block=6),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_disk_follows_the_rows(spark, case):
    """1,200 vectors of 64 in 200 blocks are 0.6 MB; a copy for each pair of blocks would be 123 MB, less as compressed."""
    v = frame(spark, np.random.default_rng(4).standard_normal((1200, 64))).localCheckpoint()
    before = on_disk(spark)
    assert CASES[case](v).count() > 0
    grown = on_disk(spark) - before
    assert grown < 5e6, grown


def components(links, nodes):
    label = {v: v for v in nodes}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b], label[a], label[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("tau,pivots", [(0.55, None), (0.62, None), (0.66, None), (0.62, 6), (0.9999, None)])
def test_giant_component_of_small_blocks(spark, tau, pivots):
    x = np.random.default_rng(7).standard_normal((240, 12))
    r = np.corrcoef(x)
    links = [(i, j) for i in range(240) for j in range(i + 1, 240) if abs(r[i, j]) > tau]
    label = components(links, {v for e in links for v in e})
    sizes: dict[int, int] = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    best = min(sizes, key=lambda c: (-sizes[c], c), default=None)
    want = {e for i, j in links if label[i] == best for e in ((i, j), (j, i))}
    got = [(e.i, e.j) for e in nw.correlation_edges(frame(spark, x), tau, block=16, giant=True, pivots=pivots).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_of_one_id_are_no_pair(spark):
    """In one block or in two; ids come in any order."""
    x = np.random.default_rng(1).standard_normal((30, 6))
    ids = np.random.default_rng(2).integers(0, 12, 30)
    r = np.corrcoef(x)
    want = sorted((min(ids[a], ids[b]), max(ids[a], ids[b]), round(r[a, b], 7)) for a in range(30) for b in range(a) if ids[a] != ids[b] and abs(r[a, b]) > 0.5)
    for block in (4, 64):
        got = sorted((e.i, e.j, round(e.w, 7)) for e in nw.similarity_blocks(frame(spark, x, ids), block, 0.5, True).collect())
        assert got == want


@pytest.mark.parametrize("digits", [None, 2, 9])
def test_densities_in_rounded_values(spark, digits):
    """Rounding to two digits puts many entries on the edges of bins."""
    x = np.random.default_rng(5).standard_normal((90, 9))
    x[10:14] = x[9] + 1e-9 * x[10:14]
    v, sim = frame(spark, x), np.corrcoef(x)
    w = sim[np.triu_indices(90, 1)]
    w = w if digits is None else np.round(w, digits)
    got = nw.edge_density_of(v, 20, digits, block=16).orderBy("bin").collect()
    top = np.abs(w).max()
    bins = np.minimum(19, np.floor(np.abs(w) * 20 / top))
    assert math.isclose(got[20].threshold, top)
    assert all(math.isclose(g.density, (bins >= g.bin).mean(), abs_tol=1e-3 if digits is None else 1e-12) for g in got)
    every = np.sort(np.concatenate([w, w, np.ones(90)]))
    for rho in (0.02, 0.1, 0.5, 0.9):
        assert math.isclose(nw.threshold_of_density_of(v, rho, digits, block=16).first()[0], every[int((1 - rho) * (90 * 90 - 90))], rel_tol=1e-9)
