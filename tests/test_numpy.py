"""Registered queries that SQL cannot express, against plain numpy versions on the same tables."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from tidelens.operators import resample as rs
from tidelens.plans import fixtures as fx
from tidelens.plans import registered
from tidelens.plans.catalog import chain

QUERIES, SQL = registered()
SEED = 7


@pytest.fixture(scope="module")
def field(spark, tables):
    wide = fx.field(spark, tables).toPandas().pivot(index="t", columns="node", values="value").sort_index()
    return wide.to_numpy(float)


@pytest.fixture(scope="module")
def square(spark, tables):
    def of(df, n=None):
        rows = df.collect()
        nodes = sorted({r.i for r in rows} | {r.j for r in rows})
        m = np.zeros((len(nodes), len(nodes)))
        for r in rows:
            m[nodes.index(r.i), nodes.index(r.j)] += r.w
        return nodes, m

    return of


def got(spark, tables, name):
    return QUERIES[name](spark, tables).toPandas()


def test_all_others_are_here():
    assert set(QUERIES) - set(SQL) == {"community_peel", "polar_membership", "mbb_ci_bca", "phase_surrogate_pvalue", "phase_surrogate_irregular", "eof", "eof_components", "varimax", "spectrum_eig", "arnoldi_left", "surrogate_spectrum", "greedy_codelength_steps", "cusp_em", "lorenz_em"}


def test_eof(spark, tables, field):
    w, v = np.linalg.eigh(np.cov(field.T, bias=True))
    w, v = w[::-1], v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(axis=0), range(5)] < 0, -1, 1)
    modes = got(spark, tables, "eof")
    assert len(modes) == 25
    for r in modes.itertuples():
        assert abs(r.eigenvalue - w[r.mode]) < 1e-4 * max(1, w[0]) and abs(r.loading - v[r.node, r.mode]) < 1e-5
    pc = (field - field.mean(axis=0)) @ v
    parts = got(spark, tables, "eof_components")
    assert len(parts) == pc.size and all(abs(r.pc - pc[r.t, r.mode]) < 1e-4 for r in parts.itertuples())


def test_varimax(spark, tables):
    x = got(spark, tables, "eof").query("mode < 3").pivot(index="node", columns="mode", values="loading").to_numpy()
    b = got(spark, tables, "varimax").pivot(index="node", columns="mode", values="loading").to_numpy()
    assert np.allclose(b.T @ b, np.eye(3), atol=1e-4) and np.allclose(b @ b.T, x @ x.T, atol=1e-4)  # a rotation of the same space
    spread = lambda m: ((m**2) ** 2).mean(axis=0).sum() - ((m**2).mean(axis=0) ** 2).sum()
    best = spread(b)
    assert best >= spread(x) - 1e-6
    for p, q in ((0, 1), (0, 2), (1, 2)):  # no turn in a plane does better
        for angle in np.linspace(-0.5, 0.5, 21):
            turn = np.eye(3)
            turn[p, p] = turn[q, q] = math.cos(angle)
            turn[p, q], turn[q, p] = -math.sin(angle), math.sin(angle)
            assert spread(b @ turn) <= best + 1e-4


def test_spectrum_eig(spark, tables, square):
    _, t = square(chain(spark, tables))
    w = np.linalg.eigvals(t)
    rows = got(spark, tables, "spectrum_eig").sort_values("k")
    assert np.allclose(np.hypot(rows.re, rows.im), np.sort(np.abs(w))[::-1][: len(rows)], atol=1e-5) and len(rows) == min(6, len(t))
    assert all(np.abs(w - complex(r.re, r.im)).min() < 1e-5 for r in rows.itertuples())


def test_arnoldi_left(spark, tables, square):
    nodes, m = square(fx.network(spark, tables))
    rows = m.sum(axis=1, keepdims=True)
    t = 0.85 * np.divide(m, rows, out=np.zeros_like(m), where=rows > 0) + 0.15 / len(m)
    pairs = got(spark, tables, "arnoldi_left")
    size = np.sort(np.abs(np.linalg.eigvals(t)))[::-1]
    for k, part in pairs.groupby("k"):
        part = part.sort_values("node")
        v, w = part.re.to_numpy() + 1j * part.im.to_numpy(), complex(part.value_re.iloc[0], part.value_im.iloc[0])
        assert part.node.tolist() == nodes and np.abs(v @ t - w * v).max() < 1e-4 and abs(abs(w) - size[k]) < 1e-5
        assert abs(np.abs(v).sum() - 1) < 1e-4
    assert (pairs[pairs.k == 0].re > 0).all()


def test_surrogate_spectrum(spark, tables):
    from tidelens.operators.markov import shuffled_counts, transition_counts

    rows, draws = got(spark, tables, "surrogate_spectrum"), shuffled_counts(transition_counts(fx.series(spark, tables)), 10, SEED).toPandas()
    assert sorted(rows["sample"].unique()) == list(range(10))
    for sample, part in draws.groupby("sample"):
        t = part.pivot(index="i", columns="j", values="n").fillna(0).to_numpy()
        w = np.linalg.eigvals(t / t.sum(axis=1, keepdims=True))
        own = rows[rows["sample"] == sample].sort_values("k")
        assert np.allclose(np.hypot(own.re, own.im), np.sort(np.abs(w))[::-1][:3], atol=1e-5) and abs(own.re.iloc[0] - 1) < 1e-6


def test_greedy_codelength(spark, tables, square):
    """At each step the merge is the best of all linked pairs, by the definition of the code length."""
    nodes, t = square(chain(spark, tables))
    p = np.zeros(len(nodes))
    for r in fx.shares(spark, tables).collect():
        p[nodes.index(r.node)] = r.p
    bits = lambda x: -sum(v * math.log2(v) for v in np.ravel(x) if v > 0)
    steps = got(spark, tables, "greedy_codelength_steps")

    def length(com):
        flow = np.zeros((len(nodes), len(nodes)))
        np.add.at(flow, (com[:, None], com[None]), p[:, None] * t)
        mass = flow.sum(axis=1)
        return bits(p) - bits(mass) + (bits(flow) - bits(mass))

    com = np.arange(len(nodes))
    for step, part in steps.groupby("step"):
        own = part.set_index("node").com.reindex(nodes).to_numpy() - 1
        if step:
            names, flow = np.unique(com), p[:, None] * t
            tries = {(a, b): length(np.where(com == b, a, com)) for a in names for b in names if a < b and flow[np.ix_(com == a, com == b)].sum() + flow[np.ix_(com == b, com == a)].sum() > 0}
            assert abs(part.l.iloc[0] - min(tries.values())) < 1e-8
        assert abs(length(own) - part.l.iloc[0]) < 1e-8
        com = own
        if step == 4:
            break


def test_phase_surrogates(spark, tables, field):
    def r(a, b):
        return abs(np.corrcoef(a, b)[0, 1])

    rows = got(spark, tables, "phase_surrogate_pvalue")
    assert len(rows) == 10
    for row in rows.itertuples():
        x, y = (field[:, k] - field[:, k].mean() for k in (row.i, row.j))
        rng = np.random.default_rng([SEED, row.i, row.j])
        beyond = sum(r(rs.phase_surrogate(x, rng), rs.phase_surrogate(y, rng)) > r(x, y) for _ in range(50))
        assert row.p == beyond / 50
    rng = np.random.default_rng(1)
    z = rng.standard_normal(256)
    assert np.allclose(np.abs(np.fft.rfft(rs.phase_surrogate(z, rng)))[1:-1], np.abs(np.fft.rfft(z))[1:-1])  # the spectrum stays


def test_bca(spark, tables, field):
    normal = NormalDist()
    draws, rows = rs.bootstrap_set(fx.field(spark, tables), 20, SEED, True).toPandas(), got(spark, tables, "mbb_ci_bca")
    assert len(rows) == 10
    for row in rows.itertuples():
        s = np.sort(draws[(draws.i == row.i) & (draws.j == row.j)].s.to_numpy())
        e = np.corrcoef(field[:, row.i], field[:, row.j])[0, 1]
        z0, c = normal.inv_cdf(min(19.5, max(0.5, (s < e).sum())) / 20), s.mean() - s
        a = (c**3).sum() / (6 * (c**2).sum() ** 1.5)
        lo, hi = (normal.cdf(z0 + (z0 + normal.inv_cdf(q)) / (1 - a * (z0 + normal.inv_cdf(q)))) for q in (0.05, 0.95))
        assert abs(row.lo - s[max(0, math.floor(20 * lo) - 1)]) < 1e-8 and abs(row.hi - s[min(19, math.ceil(20 * hi) - 1)]) < 1e-8


def test_community_peel(spark, tables):
    edges = {(r.i, r.j) for r in fx.sparse_network(spark, tables).collect()}
    members = {r.node: r.com for r in fx.members(spark, tables).collect()}
    kept = {}
    for com in sorted(set(members.values())):
        inside = {v for v, c in members.items() if c == com}
        while inside:
            deg = {v: sum((v, u) in edges or (u, v) in edges for u in inside if u != v) for v in inside}
            worst = min(inside, key=lambda v: (deg[v], v))
            if deg[worst] >= 0.5 * (len(inside) - 1):
                break
            inside.discard(worst)
        if len(inside) >= 2:
            kept[com] = inside
    want = {v: 0 for v in members} | {v: k for k, com in enumerate(sorted(kept), 1) for v in kept[com]}
    assert {r.node: r.com for r in QUERIES["community_peel"](spark, tables).collect()} == want


def test_polar_membership(spark, tables):
    states = fx.states(spark, tables).toPandas().sort_values(["series", "t"])
    xy = states[["x", "y"]].to_numpy(float)
    m, s = xy.mean(axis=0), xy.std(axis=0)
    axes = [m[a] - 3 * s[a] + np.arange(20) * 6 * s[a] / 19 for a in (0, 1)]
    at = [np.clip(np.floor((xy[:, a] - (axes[a][0] - 3 * s[a] / 19)) / (6 * s[a] / 19)), 0, 19).astype(int) for a in (0, 1)]
    cov = np.cov(xy.T) * len(xy) ** (-2 / 6)
    centres = np.array([(x, y) for y in axes[1] for x in axes[0]])
    d = centres[:, None] - xy[None]
    p = np.exp(-0.5 * np.einsum("nka,ab,nkb->nk", d, np.linalg.inv(cov), d)).sum(axis=1)
    p /= p.sum()
    level, held, of = 0, 0.0, np.zeros(400, int)
    for box in sorted(range(400), key=lambda k: (-p[k], k)):
        of[box] = level if level <= 2 else 0
        held += p[box]
        if level <= 2 and held >= 1 / 3:
            level, held = level + 1, 0.0
    mode = centres[p.argmax()]
    angle = np.mod(np.arctan2(centres[:, 1] - mode[1], centres[:, 0] - mode[0]), 2 * np.pi)
    mem = (of * 4 + np.minimum(3, np.floor(angle / (np.pi / 2))).astype(int))[at[0] + 20 * at[1]]
    dense = {v: k for k, v in enumerate(sorted(set(mem)))}
    rows = got(spark, tables, "polar_membership").sort_values(["series", "t"])
    assert (rows.mem.to_numpy() == np.array([dense[v] for v in mem])).mean() > 0.999  # boxes of equal weight may swap


@pytest.mark.parametrize("name", ["cusp_em", "lorenz_em"])
def test_euler_maruyama(spark, tables, name):
    rows = got(spark, tables, name)
    starts = {r.c_custkey: r.c_acctbal / 10000 for r in fx.read(spark, tables, "customer").select("c_custkey", "c_acctbal").collect()}
    assert sorted(rows.id.unique()) == sorted(starts)
    for i in sorted(starts)[:20]:
        rng, kept = np.random.default_rng([SEED, i]), []
        if name == "cusp_em":
            s = np.array([starts[i]])
            for k in range(1, 111):
                s = s + 0.01 * (0.1 + s - s**3) + 0.3 * 0.1 * rng.standard_normal(1)
                if k > 10 and k % 10 == 0:
                    kept.append(s)
        else:
            s = np.array([starts[i], 1.0, 20.0])
            for k in range(1, 101):
                x, y, z = s
                s = s + 0.005 * np.array([10 * (y - x), x * (28 - z) - y, x * y - 8 / 3 * z]) + 0.1 * math.sqrt(0.005) * rng.standard_normal(3) * s
                if k % 10 == 0:
                    kept.append(s)
        own = rows[rows.id == i].sort_values("t")
        assert np.allclose(own[list("xyz")[: len(s)]].to_numpy(), np.array(kept), atol=1e-8)
