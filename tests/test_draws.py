"""Counter draws: a plain version, evenness, independence of how they are cut into chunks."""

import hashlib

import numpy as np
import pytest

from tidelens.functions.draws import uniforms, uniforms_sql
from tidelens.operators import markov as mk
from tidelens.operators import resample as rs


def plain_mix(h):
    h = ((h ^ (h >> 16)) * 0x7FEB352D) % 2**32
    h = ((h ^ (h >> 15)) * 0x846CA68B) % 2**32
    return h ^ (h >> 16)


def plain(name, a, b):
    digits = hashlib.md5(name.encode()).hexdigest()
    row = plain_mix(plain_mix((int(digits[:8], 16) + a) % 2**32) ^ int(digits[8:16], 16))
    return plain_mix(row ^ plain_mix(b)) / 2**32


def test_same_as_plain_version_and_sql():
    a, b = np.array([0, 1, 7, 2**32 - 1]), np.array([0, 5, 2**31, 2**32 - 1])
    want = np.array([[plain("s|1", int(x), int(y)) for y in b] for x in a])
    assert np.array_equal(uniforms("s|1", a, b), want)
    duckdb = pytest.importorskip("duckdb")
    rows = duckdb.sql(f"SELECT {uniforms_sql(chr(39) + 's|1' + chr(39), 'a', 'b')} FROM (SELECT unnest({a.tolist()}) AS a), (SELECT unnest({b.tolist()}) AS b) ORDER BY a, b").fetchall()
    assert np.array_equal(np.array(rows).reshape(4, 4), want)


def test_even_and_unrelated():
    u = uniforms("a", np.arange(2000), np.arange(500))
    seen = np.histogram(u, 100, (0, 1))[0]
    assert ((seen - 1e4) ** 2 / 1e4).sum() < 160  # chi-square of 99 degrees
    for other in (uniforms("b", np.arange(2000), np.arange(500)), np.roll(u, 1, axis=0), np.roll(u, 1, axis=1), u[::-1]):
        assert abs(np.corrcoef(u.ravel(), other.ravel())[0, 1]) < 0.005
    assert len(np.unique(u[:, :10])) > 19_990


def test_blocks_do_not_depend_on_chunks():
    whole = rs.drawn(103, 10, 2, 5, range(60), 7, False)
    parts = [rs.drawn(103, 10, 2, 5, range(a, a + 20), 7, False) for a in (0, 20, 40)]
    for side in (0, 1):
        assert np.array_equal(whole[side], np.concatenate([p[side] for p in parts]))
    assert not np.array_equal(*whole) and whole[0].max() < 103 and whole[0].shape == (60, 103)
    same = rs.drawn(103, 10, 2, 5, range(60), 7, True)
    assert np.array_equal(*same) and np.array_equal(same[0], whole[0])


def test_row_draws_do_not_depend_on_chunks(spark):
    counts = spark.createDataFrame([(0, 0, 400), (0, 1, 600), (3, 2, 77), (5, 1, 0)], "i long, j long, n long")
    got = [sorted(map(tuple, mk.shuffled_counts(counts, 3, 9, chunk=chunk).collect())) for chunk in (64, 1 << 16)]
    assert got[0] == got[1]
    totals = {}
    for sample, i, _, n in got[0]:
        totals[sample, i] = totals.get((sample, i), 0) + n
    assert totals == {(s, i): n for s in range(3) for i, n in ((0, 1000), (3, 77))}
