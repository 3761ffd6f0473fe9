"""Uniform numbers by counters: any entry of a table of draws can be computed alone, many at once in numpy, and again in SQL.

A table has a key of 64 bits, from an MD5 of what names it (seed, pair, side), taken once. Entry (a, b) mixes the key with
the two counters by 32-bit multiplications, all of which fit in 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

MASK = np.uint64(0xFFFFFFFF)

# Fixed values of a published 32-bit integer mix: shift, multiplier, shift, multiplier, shift.
SHIFTS = (16, 15, 16)
FACTORS = (0x7FEB352D, 0x846CA68B)


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers, held as unsigned 64-bit ones."""
    for shift, factor in zip(SHIFTS, (*FACTORS, 1), strict=True):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & MASK
    return h


def uniforms(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), shape (len(a), len(b)): entries of the table ``name`` at counters below 2^32."""
    digits = hashlib.md5(name.encode()).hexdigest()
    one, two = np.uint64(int(digits[:8], 16)), np.uint64(int(digits[8:16], 16))
    rows = mixed(mixed((np.asarray(a).astype(np.uint64) + one) & MASK) ^ two)
    return mixed(rows[:, None] ^ mixed(np.asarray(b).astype(np.uint64))[None]) / 4294967296.0


def mixed_sql(h: str) -> str:
    """DuckDB SQL of ``mixed``."""
    for shift, factor in zip(SHIFTS, (*FACTORS, 1), strict=True):
        h = f"list_transform([{h}], lambda h: (xor(h, h >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT)[1]"
    return h


def uniforms_sql(name: str, a: str, b: str) -> str:
    """DuckDB SQL of an entry of ``uniforms``; all three are SQL expressions."""
    part = lambda at: f"('0x' || substr(md5({name}), {at}, 8))::UBIGINT"
    rows = mixed_sql(f"xor({mixed_sql(f'(({a})::UBIGINT + {part(1)}) & 4294967295::UBIGINT')}, {part(9)})")
    return mixed_sql(f"xor({rows}, {mixed_sql(f'({b})::UBIGINT')})") + "::DOUBLE / 4294967296e0"
