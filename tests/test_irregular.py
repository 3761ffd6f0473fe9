"""Spectra and surrogates of series that are sampled at uneven times."""

import math

import numpy as np
import pytest

from tidelens.operators import resample as rs
from tidelens.operators import spectral as sp


def frame(spark, series):
    return spark.createDataFrame([(int(t), node, None if v is None else float(v)) for node, rows in series.items() for t, v in rows], "t long, node long, value double")


def uneven(rng, n, last):
    return np.sort(rng.choice(last, n, replace=False))


def test_fits_are_least_squares():
    rng = np.random.default_rng(1)
    t = uneven(rng, 60, 200).astype(float)
    y = rng.standard_normal(60)
    omega = 2 * np.pi * np.arange(1, 40) / 200
    for most in (2_000_000, 100):
        a, b, share = sp.sinusoid_fits(t, y, omega, most)
        for k, w in enumerate(omega):
            waves = np.column_stack([np.cos(w * t), np.sin(w * t)])
            want = np.linalg.lstsq(waves, y, rcond=None)[0]
            assert np.allclose([a[k], b[k]], want) and np.isclose(share[k], 1 - ((y - waves @ want) ** 2).sum() / (y @ y))
    even = np.arange(8.0)
    _, b, share = sp.sinusoid_fits(even, np.array([1.0, -1] * 4), np.array([np.pi]))  # its sine vanishes everywhere
    assert np.isclose(share[0], 1) and abs(b[0]) < 1e-9
    assert len(sp.sinusoid_fits(even, even, np.zeros(0))[0]) == 0


def test_lomb_scargle_finds_a_wave(spark):
    rng = np.random.default_rng(2)
    t = uneven(rng, 150, 600)
    wave = np.sin(2 * np.pi * t / 37.0) + 0.5 * rng.standard_normal(150)
    field = frame(spark, {0: zip(t, wave), 1: zip(t, rng.standard_normal(150)), 2: [(5, 1.0), (9, 1.0), (11, 1.0)], 3: [(1, 2.0), (2, 3.0)], 4: [(k, None) for k in range(9)]})
    for chunk in (7, 256):
        rows = sp.lomb_scargle(field, oversample=4.0, chunk=chunk).collect()
        best = max((r for r in rows if r.node == 0), key=lambda r: r.power)
        assert abs(best.freq - 1 / 37) < 1 / 600 and best.false_alarm < 1e-6
        assert min(r.false_alarm for r in rows if r.node == 1) > 1e-3
        assert {r.node for r in rows} == {0, 1, 2}
        assert all(r.power is None and r.false_alarm is None for r in rows if r.node == 2)  # constant
        assert sorted(r.k for r in rows if r.node == 0) == list(range(1, 301))
    assert sp.lomb_scargle(field.filter("node > 9")).count() == 0
    fast = sp.lomb_scargle(field.filter("node = 0"), rate=12.0).collect()
    assert math.isclose(max(fast, key=lambda r: r.power).freq, 12 * best.freq)


def test_irregular_surrogates_keep_the_spectrum():
    rng = np.random.default_rng(3)
    t = uneven(rng, 120, 300).astype(float)
    x = np.sin(2 * np.pi * t / 30) + 0.2 * rng.standard_normal(120)
    x -= x.mean()
    got = rs.phase_surrogates(t, x, rng.random((40, 65)))
    assert got.shape == (40, 120) and np.allclose(got.mean(axis=1), 0) and np.allclose(got.std(axis=1), x.std())
    omega = 2 * np.pi * np.arange(1, 61) * 119 / 120 / (t[-1] - t[0])
    peak = np.argmax(sp.sinusoid_fits(t - t[0], x, omega)[2])
    shares = [sp.sinusoid_fits(t - t[0], g, omega)[2] for g in got]
    assert all(abs(int(np.argmax(s)) - int(peak)) <= 1 for s in shares)
    assert abs(np.mean([np.corrcoef(x, g)[0, 1] for g in got])) < 0.25
    assert np.array_equal(rs.phase_surrogates(t[:3], np.zeros(3), rng.random((2, 3))), np.zeros((2, 3)))  # a constant series


@pytest.mark.parametrize("gaps", [False, True])
def test_phase_levels(spark, gaps):
    rng = np.random.default_rng(4)
    n = 128
    x, y = rng.standard_normal(n), rng.standard_normal(n)
    rows = {0: [(k, v) for k, v in enumerate(x) if not gaps or k % 5 != 2], 1: [(k, v) for k, v in enumerate(x + 0.1 * y) if not gaps or k % 7 != 3], 2: [(k, v) for k, v in enumerate(y)], 3: [(500, 1.0)]}
    p = {(r.i, r.j): r.p for r in rs.phase_p_values(frame(spark, rows), 200, 5).collect()}
    assert set(p) == {(0, 1), (0, 2), (1, 2)}
    assert p[0, 1] == 0 and p[0, 2] > 0.01
