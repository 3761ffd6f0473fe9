"""Core numbers and community peeling against plain loops."""

import numpy as np
import pytest

from tidelens.operators import network as nw


def plain_peel(edges, members, least):
    """Drops the node of least inner degree (ties: least id) while that is too low."""
    kept = {}
    for com in set(members.values()):
        near = {v: set() for v, c in members.items() if c == com}
        for a, b in edges:
            if a != b and a in near and b in near:
                near[a].add(b)
                near[b].add(a)
        while near:
            node = min(near, key=lambda v: (len(near[v]), v))
            if len(near[node]) >= least * (len(near) - 1):
                break
            for v in near.pop(node):
                near[v].discard(node)
        kept |= dict.fromkeys(near, com)
    return kept


def plain_cores(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    cores, k = {}, 0
    while near:
        node = min(near, key=lambda v: len(near[v]))
        k = max(k, len(near[node]))
        cores[node] = k
        for v in near.pop(node):
            near[v].discard(node)
    return cores


def graph(seed, n, share):
    """Denser towards small ids, so that there are many cores."""
    rng = np.random.default_rng(seed)
    return [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < share * (1.6 - (a + b) / n)]


def test_core_numbers(spark):
    edges = graph(1, 60, 0.12)
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    got = {r.node: r.core for r in nw.core_numbers(spark.createDataFrame(sorted(both), "i long, j long")).collect()}
    assert got == plain_cores(edges) and len(set(got.values())) > 3
    assert nw.core_numbers(spark.createDataFrame([], "i long, j long")).count() == 0


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.7, 1.0])
def test_peeled(spark, least):
    edges = graph(2, 75, 0.25) + [(200, 201), (201, 202), (0, 0), (3, 400)]
    members = {v: v % 3 + 1 for v in range(75)} | {200: 8, 201: 8, 202: 8, 300: 9, 301: 9, 310: 10}
    mat = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "i long, j long, w double")
    rows = list(members.items())
    got = nw.peeled(mat, spark.createDataFrame(rows + rows[:5], "node long, com long"), least).collect()
    assert {r.node: r.com for r in got} == plain_peel(edges, members, least) and len(got) == len({r.node for r in got})
