"""Resampling inference: moving-block bootstrap and phase surrogates for statistics of pairs of series.

Draws are mixed counters (sample, block) under a key of (seed, pair, side), so results do not depend on partitions and can be repeated. A
series is one row with its values in an array; a pair is a row with both, repeated for each chunk of samples, so the
work spreads over pairs and samples and no row is made for a resampled value. Pairs are formed between blocks of series
by an equi-join on block numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.draws import uniforms
from tidelens.functions.scalar import block_length, pair_block_length
from tidelens.operators.spectral import sinusoid_fits
from tidelens.operators.timeseries import lag_autocorrelation

Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]


def series_arrays(field: DataFrame, lag1: bool = False) -> DataFrame:
    """(node, ts, xs): times and values of each node where there is a value, in time; with ``lag1`` also a, its lag-1
    autocorrelation (0 where there is none)."""
    rows = field.filter("value is not null").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("value")))).alias("s"))
    rows = rows.select("node", F.transform("s", lambda x: x["t"]).alias("ts"), F.transform("s", lambda x: x["value"]).alias("xs"))
    return rows.join(lag_autocorrelation(field, 1), "node", "left").select("node", "ts", "xs", F.coalesce("a", F.lit(0.0)).alias("a")) if lag1 else rows


def pair_arrays(field: DataFrame, other: DataFrame | None = None, auto: bool = False, blocks: int = 16, lag1: bool = False) -> DataFrame:
    """(i, j, tx, x, ty, y): pairs i < j of one field, all pairs of a node of ``field`` and one of ``other``, or with
    ``auto`` each node with itself; with ``lag1`` also ax, ay, the lag-1 autocorrelations of both, joined to the series."""
    if auto and other is not None:
        raise ValueError("auto takes one field")
    more = ["a"] if lag1 else []
    sided = lambda rows, node, side: rows.select(F.col("node").alias(node), F.col("ts").alias(f"t{side}"), F.col("xs").alias(side), *[F.col(c).alias(c + side) for c in more])
    first = series_arrays(field, lag1)
    if auto:
        return first.select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("ts").alias("tx"), F.col("xs").alias("x"), F.col("ts").alias("ty"), F.col("xs").alias("y"), *[F.col(c).alias(c + side) for side in "xy" for c in more])
    x, y = sided(first, "i", "x"), sided(first if other is None else series_arrays(other, lag1), "j", "y")
    every, own = F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    x, y = x.withColumn("bi", own("i")).withColumn("bj", F.explode(every)), y.withColumn("bj", own("j")).withColumn("bi", F.explode(every))
    both = x.join(y, ["bi", "bj"]).drop("bi", "bj")
    return both.filter("i < j") if other is None else both


def pairs_with_lengths(field: DataFrame, other: DataFrame | None = None, auto: bool = False, length: int | None = None) -> DataFrame:
    """``pair_arrays`` with n (common times) and l (block length: ``length``, or from the lag-1 autocorrelations)."""
    pairs = pair_arrays(field, other, auto, lag1=length is None).withColumn("n", F.when(F.col("tx") == F.col("ty"), F.size("tx")).otherwise(F.size(F.array_intersect("tx", "ty"))).cast("long"))
    if length is not None:
        return pairs.withColumn("l", F.lit(length).cast("long"))
    return pairs.withColumn("l", pair_block_length(F.col("ax"), F.col("ay"), "n")).drop("ax", "ay")


def pair_lengths(field: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(i, j, n, l): common values and block length of each pair that has any."""
    return pairs_with_lengths(field, other).filter("n > 0").select("i", "j", "n", "l")


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices; nan where either is constant."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.divide((x * y).sum(axis=1), size, out=np.full(len(x), np.nan), where=size > 0)


def covariances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - x.mean(axis=1, keepdims=True)) * (y - y.mean(axis=1, keepdims=True))).mean(axis=1)


def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of y on x."""
    v = x.var(axis=1)
    return np.divide(covariances(x, y), v, out=np.full(len(x), np.nan), where=v > 0)


def statistic(kind: str | Callable) -> Statistic:
    """A function of two matrices (samples in rows): corr, cov, slope, or any Python function of two series."""
    if callable(kind):
        return lambda x, y: np.array([float(kind(a, b)) for a, b in zip(x, y, strict=True)])
    known = {"corr": correlations, "cov": covariances, "slope": slopes}
    if kind not in known:
        raise ValueError(f"unknown statistic {kind!r}; pass a Python function instead")
    return known[kind]


def lagged(lag: int) -> Statistic:
    """Correlation of x at p with y at p + lag."""
    return lambda x, y: correlations(x[:, max(0, -lag) : x.shape[1] - max(0, lag)], y[:, max(0, lag) : y.shape[1] - max(0, -lag)])


def drawn(n: int, length: int, i: int, j: int, samples: range, seed: int, paired: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (samples, n) of both sides: blocks that start in 0..n-length-1, laid end to end, the last one cut at n."""
    sides = []
    for side in "x" if paired else "xy":
        starts = np.floor(uniforms(f"{seed}|{i}|{j}|{side}", np.arange(samples.start, samples.stop), np.arange(-(-n // length))) * (n - length)).astype(np.int64)
        sides.append((starts[:, :, None] + np.arange(length)).reshape(len(samples), -1)[:, :n])
    return sides[0], sides[-1]


def common(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of both sides of row k at their common times."""
    tx, x, ty, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("tx", "x", "ty", "y"))
    if np.array_equal(tx, ty):
        return x, y
    _, at, bt = np.intersect1d(tx, ty, return_indices=True)
    return x[at], y[bt]


def resampled_set(pairs: DataFrame, samples: int, seed: int, paired: bool, statistics: list[Statistic], chunk: int = 256, most_values: int = 4_000_000) -> DataFrame:
    """(i, j, sample, k, s) of ``pairs`` with n and l: statistic k of each resample; pairs whose blocks reach n have none."""
    rows = pairs.filter("l < n and n > 2").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(max(0, samples - 1)), F.lit(chunk))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["i", "j", "sample", "k", "s"]
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, l, first = (batch.column(c)[r].as_py() for c in ("i", "j", "l", "first"))
                x, y = common(batch, r)
                last, step = min(samples, first + chunk), max(1, most_values // len(x))
                for a in range(first, last, step):
                    own = range(a, min(last, a + step))
                    px, py = drawn(len(x), l, i, j, own, seed, paired)
                    sx, sy = x[px], y[py]
                    for k, f in enumerate(statistics):
                        m = len(own)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i)), pa.array(np.full(m, j)), pa.array(np.arange(own.start, own.stop)), pa.array(np.full(m, k)), pa.array(f(sx, sy), pa.float64(), from_pandas=True)], names=names)

    return rows.select("i", "j", F.col("l").cast("long").alias("l"), "first", "tx", "x", "ty", "y").mapInArrow(run, "i long, j long, sample long, k long, s double")


def bootstrap_set(field: DataFrame, samples: int, seed: int = 0, paired: bool = False, kind: str | Callable = "corr", length: int | None = None, other: DataFrame | None = None, auto: bool = False) -> DataFrame:
    """(i, j, sample, s): the statistic of each resample; pairs whose block length reaches n have none.

    ``paired`` takes the same blocks of both sides (keeps their relation), else sides are drawn independently. ``other``
    gives all pairs of two fields, ``auto`` each node with itself.
    """
    pairs = pairs_with_lengths(field, other, auto, length)
    return resampled_set(pairs, samples, seed, paired, [statistic(kind)]).drop("k")


def estimates(field: DataFrame, kind: str | Callable = "corr", other: DataFrame | None = None, auto: bool = False) -> DataFrame:
    """(i, j, estim): the statistic of each pair that has common values."""
    f = statistic(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *xy) for k in range(batch.num_rows) if len((xy := common(batch, k))[0])]
            at = pa.array([k for k, _, _ in rows], pa.int64())
            values = [float(f(x[None], y[None])[0]) for _, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("i").take(at), batch.column("j").take(at), pa.array(values, pa.float64(), from_pandas=True)], names=["i", "j", "estim"])

    return pair_arrays(field, other, auto).mapInArrow(run, "i long, j long, estim double")


def beyond_estimates(pairs: DataFrame, samples: int, seed: int, paired: bool, f: Statistic, chunk: int = 256, most_values: int = 4_000_000) -> DataFrame:
    """(i, j, l, n, estim, beyond, drawn) of ``pairs`` with n and l: how many resamples are beyond the estimate, of how many.
    Resamples are drawn, compared and counted where the pair's arrays are; a chunk of samples gives one row."""
    able = F.expr("l < n and n > 2")
    chunks = F.when(able, F.sequence(F.lit(0), F.lit(max(0, samples - 1)), F.lit(chunk))).otherwise(F.array(F.lit(0)))
    rows = pairs.filter("n > 0").withColumn("able", able).withColumn("first", F.explode(chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            estim, beyond, drew = [], [], []
            for r in range(batch.num_rows):
                i, j, l, able, first = (batch.column(c)[r].as_py() for c in ("i", "j", "l", "able", "first"))
                x, y = common(batch, r)
                e, over, count = float(f(x[None], y[None])[0]), 0, 0
                last, step = min(samples, first + chunk) if able and e == e else first, max(1, most_values // len(x))
                for a in range(first, last, step):
                    px, py = drawn(len(x), l, i, j, range(a, min(last, a + step)), seed, paired)
                    s = f(x[px], y[py])
                    over, count = over + int((np.abs(s) > abs(e)).sum()), count + int((s == s).sum())
                estim.append(e)
                beyond.append(over)
                drew.append(count)
            columns = [pa.array(estim, pa.float64(), from_pandas=True), pa.array(beyond, pa.int64()), pa.array(drew, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("i", "j", "l", "n")), *columns], names=["i", "j", "l", "n", "estim", "beyond", "drawn"])

    counted = rows.select("i", "j", F.col("l").cast("long").alias("l"), "n", "able", "first", "tx", "x", "ty", "y").mapInArrow(run, "i long, j long, l long, n long, estim double, beyond long, drawn long")
    return counted.groupBy("i", "j", "l", "n").agg(F.max("estim").alias("estim"), F.sum("beyond").alias("beyond"), F.sum("drawn").alias("drawn"))


def p_values(field: DataFrame, samples: int, seed: int = 0, kind: str | Callable = "corr", length: int | None = None, other: DataFrame | None = None, auto: bool = False, paired: bool = False, level: str = "percentile", df: float = 0) -> DataFrame:
    """(i, j, estim, l, p): share of resamples (independent blocks, unless ``paired``) beyond the estimate; p = 1 where
    blocks reach n. ``level`` 'normal' or 'student' (``df`` degrees): the upper tail of that law at |estimate| instead."""
    if level not in ("percentile", "normal", "student"):
        raise ValueError(f"unknown level {level!r}")
    found = beyond_estimates(pairs_with_lengths(field, other, auto, length), samples if level == "percentile" else 0, seed, paired, statistic(kind))
    if level == "percentile":
        p = F.try_divide("beyond", "drawn")
    else:
        cdf = NormalDist().cdf if level == "normal" else lambda t: student_cdf(t, df)

        def tail(v: pd.Series) -> pd.Series:
            return v.map(lambda e: 1 - cdf(abs(e)) if e == e else None).astype(float)

        p = F.when(F.col("l") < F.col("n"), F.pandas_udf(tail, "double")("estim"))
    return found.withColumn("p", p).select("i", "j", "estim", "l", F.coalesce("p", F.lit(1.0)).alias("p"))


def surrogate_p_values(field: DataFrame, samples: int, sample_method: str = "mbb", seed: int = 0, **how) -> DataFrame:
    """(i, j, p) by 'mbb' (independent moving blocks) or 'phase' (random phases)."""
    if sample_method == "mbb":
        return p_values(field, samples, seed, **how).select("i", "j", "p")
    if sample_method == "phase":
        return phase_p_values(field, samples, seed, **how)
    raise ValueError(f"unknown sample method {sample_method!r}")


def order_statistic(drawn: DataFrame, value: Column, rank: Column, name: str) -> DataFrame:
    """(i, j, name): the value at a 1-based rank among the samples of each pair."""
    n = Window.partitionBy("i", "j")
    placed = drawn.withColumn("v", value).withColumn("r", F.row_number().over(n.orderBy("v", "sample"))).withColumn("ns", F.count("*").over(n))
    return placed.filter(F.col("r") == rank).select("i", "j", F.col("v").alias(name))


def critical_values(field: DataFrame, samples: int, alpha: float, seed: int = 0, length: int | None = None, level: str = "percentile", fisher: bool = False, df: float = 0, other: DataFrame | None = None) -> DataFrame:
    """(i, j, critical): |statistic| at rank ceil((1 - alpha) samples) under independence; infinite where blocks reach n.

    ``level`` 'normal' or 'student' (``df`` degrees): the quantile of that law for every pair instead, on the scale of
    Fisher's transform with ``fisher`` (which leaves ranks, so the percentile level, as they are).
    """
    if level in ("normal", "student"):
        q = NormalDist().inv_cdf(1 - alpha) if level == "normal" else student_quantile(1 - alpha, df)
        return estimates(field, other=other).select("i", "j", F.lit(math.tanh(q) if fisher else q).alias("critical"))
    if level != "percentile":
        raise ValueError(f"unknown level {level!r}")
    drawn = bootstrap_set(field, samples, seed, False, length=length, other=other)
    at = F.greatest(F.lit(1), F.ceil(F.col("ns") * (1 - alpha))).cast("int")
    got = order_statistic(drawn, F.abs("s"), at, "critical")
    return estimates(field, other=other).select("i", "j").join(got, ["i", "j"], "left").select("i", "j", F.coalesce("critical", F.lit(float("inf"))).alias("critical"))


def percentile_interval(field: DataFrame, samples: int, alpha: float, seed: int = 0, length: int | None = None) -> DataFrame:
    """(i, j, lo, hi): paired resamples at ranks floor(alpha/2 ns) and ceil((1 - alpha/2) ns), 1-based; (-1, 1) where blocks reach n."""
    drawn = bootstrap_set(field, samples, seed, True, length=length)
    low = order_statistic(drawn, F.col("s"), F.greatest(F.lit(1), F.floor(F.col("ns") * alpha / 2)).cast("int"), "lo")
    high = order_statistic(drawn, F.col("s"), F.least(F.col("ns"), F.ceil(F.col("ns") * (1 - alpha / 2))).cast("int"), "hi")
    return estimates(field).select("i", "j").join(low, ["i", "j"], "left").join(high, ["i", "j"], "left").select("i", "j", F.coalesce("lo", F.lit(-1.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))


def student_cdf(t: float, df: float) -> float:
    """Student's t distribution by the incomplete beta function."""

    def beta_share(a: float, b: float, x: float) -> float:
        """Regularised incomplete beta function, by Simpson's rule on its integrand after x = sin^2."""
        top, n = math.asin(math.sqrt(x)), 2000
        f = lambda u: math.sin(u) ** (2 * a - 1) * math.cos(u) ** (2 * b - 1) if 0 < u else (1.0 if a == 0.5 else 0.0)
        h = top / n
        area = h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(k * h) for k in range(n + 1))
        return 2 * area * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))

    if t == 0:
        return 0.5
    tail = 0.5 * beta_share(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def student_quantile(p: float, df: float) -> float:
    """Its inverse, by bisection."""
    low, high = -1e3, 1e3
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def intervals(field: DataFrame, samples: int, alpha: float, method: str = "normal", seed: int = 0, fisher: bool = False, df: float = 0) -> DataFrame:
    """(i, j, lo, hi) by 'normal', 'student' or 'bca' from paired resamples; each pair's set is one small group.

    BCa takes its acceleration from the skewness of the resamples, not from a jackknife.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, e = np.sort(pdf["s"].dropna().to_numpy()), float(pdf["estim"].iloc[0])
        if fisher:
            s, e = np.arctanh(np.clip(s, -1 + 1e-12, 1 - 1e-12)), math.atanh(min(1 - 1e-12, max(-1 + 1e-12, e)))
        normal = NormalDist()
        if len(s) < 2:
            lo, hi = -1.0, 1.0
        elif method == "bca":
            below = min(len(s) - 0.5, max(0.5, float((s < e).sum())))
            z0, c = normal.inv_cdf(below / len(s)), s.mean() - s
            a = float((c**3).sum() / (6 * ((c**2).sum() ** 1.5 + 1e-300)))
            at = [normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (normal.inv_cdf(alpha / 2), normal.inv_cdf(1 - alpha / 2))]
            lo, hi = s[max(0, math.floor(at[0] * len(s)) - 1)], s[min(len(s) - 1, math.ceil(at[1] * len(s)) - 1)]
        else:
            q = normal.inv_cdf(1 - alpha / 2) if method == "normal" else student_quantile(1 - alpha / 2, df or len(s) - 1)
            lo, hi = e - q * s.std(), e + q * s.std()
        if fisher:
            lo, hi = math.tanh(lo), math.tanh(hi)
        return pd.DataFrame({"i": pdf["i"].iloc[:1].to_numpy(), "j": pdf["j"].iloc[:1].to_numpy(), "lo": [float(lo)], "hi": [float(hi)]})

    return bootstrap_set(field, samples, seed, True).join(estimates(field), ["i", "j"]).groupBy("i", "j").applyInPandas(run, "i long, j long, lo double, hi double")


def univariate_set(field: DataFrame, samples: int, seed: int = 0, lag: int = 1) -> DataFrame:
    """(node, sample, s): lag autocorrelation of block resamples of each series."""
    a = lag_autocorrelation(field, 1).select(F.col("node").alias("i"), F.greatest("a", F.lit(0.0)).alias("a"))
    pairs = pair_arrays(field, auto=True).withColumn("n", F.size("x").cast("long")).join(a, "i").withColumn("l", F.least(F.col("n") - 1, block_length("a", "n")))
    return resampled_set(pairs, samples, seed, True, [lagged(lag)]).select(F.col("i").alias("node"), "sample", "s")


def univariate_critical(field: DataFrame, samples: int, alpha: float, seed: int = 0) -> DataFrame:
    """(node, critical): |s| at rank ceil((1 - alpha) samples)."""
    drawn = univariate_set(field, samples, seed).select(F.col("node").alias("i"), F.col("node").alias("j"), "sample", "s")
    at = F.greatest(F.lit(1), F.ceil(F.col("ns") * (1 - alpha))).cast("int")
    return order_statistic(drawn, F.abs("s"), at, "critical").select(F.col("i").alias("node"), "critical")


def pair_from_nodes(values: DataFrame, method: str = "max") -> DataFrame:
    """(i, j, v): for i < j the greater ('max'), the lesser ('min') or the mean of two node values (node, v)."""
    join = {"max": F.greatest, "min": F.least, "mean": lambda x, y: (F.col(x) + F.col(y)) / 2}
    if method not in join:
        raise ValueError(f"no method {method!r} to augment node values to pairs")
    a, b = values.select(F.col("node").alias("i"), F.col("v").alias("vi")), values.select(F.col("node").alias("j"), F.col("v").alias("vj"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", join[method]("vi", "vj").alias("v"))


def phase_surrogate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series of the same spectrum with random phases: zero-padded to a power of two, rotated, cut back."""
    n = 1 << (len(x) - 1).bit_length() if len(x) > 1 else 1
    spectrum = np.fft.rfft(x, n)
    return np.fft.irfft(spectrum * np.exp(2j * np.pi * rng.random(len(spectrum))), n)[: len(x)]


def phase_surrogates(times: np.ndarray, x: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Surrogates of ``x`` (of mean 0) at its own ``times``, a row for each row of ``turns`` (shares of a full turn of phase).

    Evenly spaced values are transformed, padded to a power of two. Others are a sum of sinusoids with the amplitudes that
    fit x at the frequencies of as many even values, in a series' own variance; waves are summed in parts.
    """
    if len(np.unique(np.diff(times))) <= 1:
        size = spectrum_size(len(x))
        return np.fft.irfft(np.fft.rfft(x, size) * np.exp(2j * np.pi * turns[:, : size // 2 + 1]), size, axis=1)[:, : len(x)]
    t = times - times[0]
    omega = 2 * np.pi * np.arange(1, len(x) // 2 + 1) * (len(x) - 1) / (len(x) * float(t[-1]))
    a, b, _ = sinusoid_fits(t, x, omega)
    size, angle, out = np.hypot(a, b), 2 * np.pi * turns[:, : len(omega)], np.zeros((len(turns), len(x)))
    for first in range(0, len(omega), 512):
        part = slice(first, first + 512)
        wave = omega[part, None] * t
        out += (size[part] * np.cos(angle[:, part])) @ np.cos(wave) - (size[part] * np.sin(angle[:, part])) @ np.sin(wave)
    out -= out.mean(axis=1, keepdims=True)
    spread = out.std(axis=1, keepdims=True)
    return np.divide(out, spread, out=np.zeros_like(out), where=spread > 0) * x.std()


def spectrum_size(n: int) -> int:
    return 1 << (n - 1).bit_length() if n > 1 else 1


def phase_p_values(field: DataFrame, samples: int, seed: int = 0, most_values: int = 2_000_000) -> DataFrame:
    """(i, j, p): share of phase surrogates whose |correlation| exceeds the pair's, at the pair's common times, evenly spaced
    or not. A pair is a row of two arrays; its surrogates are made many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                i, j = batch.column("i")[r].as_py(), batch.column("j")[r].as_py()
                tx, ty = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("tx", "ty"))
                times = np.intersect1d(tx, ty).astype(float)
                if not len(times):
                    continue
                x, y = (v - v.mean() for v in common(batch, r))
                size, rng, beyond = spectrum_size(len(x)), np.random.default_rng([seed, i, j]), 0
                own = abs(np.nan_to_num(correlations(x[None], y[None])[0]))
                step = max(1, most_values // size)
                for a in range(0, samples, step):
                    turns = rng.random((min(step, samples - a), 2, size // 2 + 1))
                    beyond += int((np.abs(np.nan_to_num(correlations(phase_surrogates(times, x, turns[:, 0]), phase_surrogates(times, y, turns[:, 1])))) > own).sum())
                out.append((i, j, beyond / samples))
            i, j, p = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(p, pa.float64())], names=["i", "j", "p"])

    return pair_arrays(field).mapInArrow(run, "i long, j long, p double")


def ccf_band(first: DataFrame, second: DataFrame, most_lag: int, samples: int, alpha: float = 0.05, seed: int = 0, length: int = 10) -> DataFrame:
    """(lag, c, lo, hi): the cross-correlation function and the band of its values under independent block resamples."""
    from tidelens.operators.timeseries import ccf

    field = first.select("t", F.lit(0).cast("long").alias("node"), "value").unionByName(second.select("t", F.lit(1).cast("long").alias("node"), "value"))
    pairs = pair_arrays(field).withColumn("n", F.size(F.array_intersect("tx", "ty")).cast("long")).withColumn("l", F.least(F.lit(length).cast("long"), F.col("n") - 1))
    lags = range(-most_lag, most_lag + 1)
    null = resampled_set(pairs, samples, seed, False, [lagged(lag) for lag in lags]).withColumn("lag", (F.col("k") - most_lag).cast("int"))
    band = null.groupBy("lag").agg(F.percentile("s", F.lit(alpha / 2)).alias("lo"), F.percentile("s", F.lit(1 - alpha / 2)).alias("hi"))
    return ccf(first, second, most_lag).join(band, "lag").select("lag", "c", "lo", "hi")
