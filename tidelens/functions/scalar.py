"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI_E = 2 * math.pi * math.e
EARTH_RADIUS_M = 6371009.0


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null where den is 0 (ANSI division would fail)."""
    return F.try_divide(as_col(num), as_col(den))


def plog2p(p: Column | str) -> Column:
    """p log2 p, 0 for p <= 0."""
    p = as_col(p)
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def plogp(p: Column | str) -> Column:
    p = as_col(p)
    return F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))


def gaussian_entropy(variance: Column | str) -> Column:
    """Bits of a normal variable: half log2(2 pi e variance)."""
    return F.lit(0.5) * F.log2(F.lit(TWO_PI_E) * as_col(variance))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over pairs without nulls; null where either side is constant."""
    x, y = as_col(x), as_col(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def block_length(a: Column | str, n: Column | str) -> Column:
    """Optimal block length of one series from its lag-1 autocorrelation (half away from zero, at least 1)."""
    a, n = as_col(a), as_col(n)
    return F.greatest(F.lit(1), F.round(F.pow(F.lit(math.sqrt(6.0)) * a / (1 - a * a), F.lit(2.0 / 3.0)) * F.pow(n.cast("double"), F.lit(1.0 / 3.0)))).cast("long")


def pair_block_length(ax: Column | str, ay: Column | str, n: Column | str) -> Column:
    """Block length of a pair: n - 1 for a unit root, 1 if neither is persistent, else from the geometric mean."""
    ax, ay, n = as_col(ax), as_col(ay), as_col(n)
    joint = F.when((ax <= 0) & (ay <= 0), F.lit(None).cast("double")).when(ax <= 0, ay).when(ay <= 0, ax).otherwise(F.sqrt(F.abs(ax * ay)))
    return F.when((ax >= 1) | (ay >= 1), n.cast("long") - 1).when(joint.isNull(), F.lit(1).cast("long")).otherwise(block_length(joint, n))


def mudelsee_length(ax: Column | str, ay: Column | str) -> Column:
    """Four times the longer AR(1) persistence time."""
    return F.lit(4.0) * F.greatest(persistence(ax), persistence(ay))


def persistence(a: Column | str, d: float = 1.0) -> Column:
    """AR(1) persistence time -d / ln(a) of an autocorrelation at lag d; null unless 0 < a < 1."""
    a = as_col(a)
    return F.when((a > 0) & (a < 1), -F.lit(float(d)) / F.log(a))


def great_circle(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    """Metres along the sphere, by the law of cosines."""
    lon1, lat1, lon2, lat2 = (F.radians(as_col(c)) for c in (lon1, lat1, lon2, lat2))
    cosine = F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(lon1 - lon2)
    return F.lit(EARTH_RADIUS_M) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def planar_degrees(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    """Degrees in the plane, the longitude difference taken modulo 180."""
    dlon = F.pmod(as_col(lon1) - as_col(lon2), F.lit(180.0))
    return F.sqrt(F.pow(dlon, 2) + F.pow(as_col(lat1) - as_col(lat2), 2))
