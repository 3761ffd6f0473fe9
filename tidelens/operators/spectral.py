"""Spectra: periodograms, Fourier transforms, principal components, rotation, eigenpairs, surrogate spectra."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions.storage import cut_lineage
from tidelens.operators import krylov

MOST_NODES = 5000  # of the smaller side of a field, and of the matrices of groups


def next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def frequencies(spark: SparkSession, n: int, rate: float = 1.0, centred: bool = True) -> DataFrame:
    """(k, freq) at the next power of two; centred: ascending from the most negative one."""
    size = next_pow2(n)
    k = F.col("id")
    if centred:
        return spark.range(size).select(k.alias("k"), ((k - size // 2) * (rate / size)).alias("freq"))
    return spark.range(size).select(k.alias("k"), (F.when(k < (size + 1) // 2, k).otherwise(k - size) * (rate / size)).alias("freq"))


WINDOWS = {"hamming": np.hamming, "hann": np.hanning, "blackman": np.blackman, "none": np.ones}


def periodogram(field: DataFrame, segment: int | None = None, rate: float = 1.0, window: str = "hamming") -> DataFrame:
    """(node, k, freq, power, rms, std): mean over disjoint whole segments of the power at non-negative frequencies.

    Without ``segment`` a series is one, from t = 0 to the last time of all. Each segment is freed of its mean, tapered
    by ``window``, padded to a power of two, transformed as one array and scaled to unit total power (over all, positive
    and negative, frequencies). ``rms`` is the root mean square over the segments.
    """
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window!r}")
    if segment is None:
        segment = int(field.agg(F.coalesce(F.max("t"), F.lit(0))).first()[0]) + 1
    size, taper = next_pow2(segment), WINDOWS[window](segment)
    rows = field.filter("value is not null").withColumn("seg", F.floor(F.col("t") / segment)).withColumn("u", F.col("t") - F.col("seg") * segment)
    series = rows.groupBy("node", "seg").agg(F.array_sort(F.collect_list(F.struct("u", F.col("value").cast("double").alias("value")))).alias("x")).filter(F.size("x") == segment)

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        both = np.full(size // 2 + 1, 2.0)
        both[[0, -1]] = 1.0  # the mean and the highest frequency have no negative counterpart
        p = np.abs(np.fft.rfft((x - x.mean()) * taper, size)) ** 2
        total = float(p @ both)
        return [p / total if total else np.full(len(p), np.nan)]

    shares = series_kernel(series.select("node", F.transform("x", lambda v: v["value"]).alias("x")), ["x"], kernel, ["k", "p"]).withColumn("p", F.nanvl("p", F.lit(None).cast("double")))
    got = shares.groupBy("node", "k").agg(F.avg("p").alias("power"), F.sqrt(F.avg(F.col("p") * F.col("p"))).alias("rms"), F.stddev_pop("p").alias("std"))
    return got.select("node", "k", (F.col("k") * (rate / size)).alias("freq"), "power", "rms", "std")


def series_kernel(rows: DataFrame, arrays: list[str], kernel: Callable[..., list[np.ndarray]], names: list[str]) -> DataFrame:
    """(node, names...): ``kernel`` of the arrays of each row (node, arrays...); the first name is the place, 0, 1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                got = kernel(*(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in arrays))
                n = len(got[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("node")[r].as_py())), pa.array(np.arange(n)), *map(pa.array, got)], names=["node", *names])

    return rows.select("node", *arrays).mapInArrow(run, f"node long, {names[0]} long, " + ", ".join(f"{c} double" for c in names[1:]))


def fourier(field: DataFrame, size: int | None = None) -> DataFrame:
    """(node, k, re, im), k = 0..size-1: the transform of each series (t, node, value; without gaps) padded with zeros to
    ``size``, the next power of two by default."""

    def kernel(x: np.ndarray) -> list[np.ndarray]:
        w = np.fft.fft(x, size or next_pow2(len(x)))
        return [w.real, w.imag]

    series = field.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("value")))).alias("x"))
    return series_kernel(series.select("node", F.transform("x", lambda v: v["value"]).alias("x")), ["x"], kernel, ["k", "re", "im"])


def inverse_fourier(lines: DataFrame, length: int | None = None) -> DataFrame:
    """(node, t, value): the real series of (node, k, re, im), its first ``length`` values."""
    series = lines.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "re", "im"))).alias("x"))
    series = series.select("node", F.transform("x", lambda v: v["re"]).alias("re"), F.transform("x", lambda v: v["im"]).alias("im"))
    return series_kernel(series, ["re", "im"], lambda re, im: [np.fft.ifft(re + 1j * im).real[:length]], ["t", "value"])


def sinusoid_fits(t: np.ndarray, y: np.ndarray, omega: np.ndarray, most_values: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, share) by angular frequency: a cos(omega t) + b sin(omega t) fits y best, and takes ``share`` of its squares.

    Times are shifted so that sine and cosine are orthogonal over them (as in the Lomb-Scargle periodogram); a wave that
    vanishes at all times counts as 0. Frequencies are taken in parts of bounded size.
    """
    step, parts = max(1, most_values // max(1, len(t))), []
    total = float(y @ y)
    for first in range(0, len(omega), step):
        w = omega[first : first + step, None]
        turn = np.arctan2(np.sin(2 * w * t).sum(axis=1), np.cos(2 * w * t).sum(axis=1)) / 2
        angle = w * t - turn[:, None]
        c, s = np.cos(angle), np.sin(angle)
        cc, ss, least = (c * c).sum(axis=1), (s * s).sum(axis=1), 1e-9 * len(t)
        yc, ys = c @ y, s @ y
        p, q = np.divide(yc, cc, out=np.zeros(len(w)), where=cc > least), np.divide(ys, ss, out=np.zeros(len(w)), where=ss > least)
        share = (p * yc + q * ys) / total if total else np.full(len(w), np.nan)
        parts.append((p * np.cos(turn) - q * np.sin(turn), p * np.sin(turn) + q * np.cos(turn), share))
    a, b, share = zip(*parts, strict=True) if parts else ([np.zeros(0)],) * 3
    return np.concatenate(a), np.concatenate(b), np.concatenate(share)


def lomb_scargle(field: DataFrame, oversample: float = 4.0, highest: float = 1.0, rate: float = 1.0, chunk: int = 256) -> DataFrame:
    """(node, k, freq, power, false_alarm): the spectrum of series that are sampled at any times, gaps included.

    Frequencies are k rate / (oversample span) for k = 1, 2, ... up to ``highest`` times what the same number of evenly
    spaced values would resolve. The power of a sinusoid is in units of the series' variance; ``false_alarm`` is the
    probability that noise has as much somewhere among the independent frequencies. Series of fewer than 3 values or
    a single time give nothing, constant ones null. A task takes ``chunk`` frequencies of a series.
    """
    rows = field.filter("value is not null").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("value")))).alias("x"))
    n = F.size("x")
    span = (F.get("x", n - 1)["t"] - F.get("x", F.lit(0))["t"]).cast("double")
    rows = rows.withColumn("span", span).withColumn("most", F.floor(n * (0.5 * oversample * highest)).cast("long")).filter((n > 2) & (F.col("span") > 0) & (F.col("most") > 0))
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), "most", F.lit(chunk).cast("long"))))
    rows = rows.select("node", "span", "most", "first", F.transform("x", lambda v: v["t"].cast("double")).alias("t"), F.transform("x", lambda v: v["value"]).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                node, span, most, first = (batch.column(c)[r].as_py() for c in ("node", "span", "most", "first"))
                t, y = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("t", "y"))
                k = np.arange(first, min(first + chunk, most + 1))
                freq = k / (oversample * span)
                power = sinusoid_fits(t - t[0], y - y.mean(), 2 * np.pi * freq)[2] * (len(y) - 1) / 2
                with np.errstate(divide="ignore"):  # no power: certain
                    alarm = -np.expm1(2 * most / oversample * np.log1p(-np.exp(-power)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), node)), pa.array(k), pa.array(freq * rate), pa.array(power, from_pandas=True), pa.array(alarm, from_pandas=True)], names=["node", "k", "freq", "power", "false_alarm"])

    return rows.mapInArrow(run, "node long, k long, freq double, power double, false_alarm double")


def spectrum_band(perio: DataFrame) -> DataFrame:
    """What a plot of the spectrum shows: power and a band of half an ``rms`` to either side."""
    return perio.withColumn("lo", F.col("power") - F.col("rms") / 2).withColumn("hi", F.col("power") + F.col("rms") / 2)


def covariance(field: DataFrame, correlation: bool = False) -> DataFrame:
    """(i, j, w) for i <= j: population covariance (or correlation) of nodes over common times."""
    from tidelens.functions.scalar import safe_corr

    a, b = field.select("t", F.col("node").alias("i"), F.col("value").alias("x")), field.select("t", F.col("node").alias("j"), F.col("value").alias("y"))
    value = safe_corr("x", "y") if correlation else F.covar_pop("x", "y")
    return a.join(b, "t").filter("i <= j and x is not null and y is not null").groupBy("i", "j").agg(value.alias("w"))


def eof(field: DataFrame, correlation: bool = False, count: int | None = None, rows_of_block: int = 4096) -> DataFrame:
    """(mode, node, eigenvalue, loading): the ``count`` leading modes, by default all, by decreasing eigenvalue; a loading's
    component of greatest size is positive.

    Anomalies (over the deviation, with ``correlation``) are rows along the longer side of the field, times or nodes, as
    arrays along the shorter one. Tasks reduce their rows to triangles (QR), triangles are stacked and reduced again, and
    the last one, of the shorter side, is decomposed: no matrix of the longer side exists anywhere. A missing value counts
    as its node's mean, and a constant node as zeros.
    """
    spark = field.sparkSession
    rows = field.filter("value is not null").select("t", "node", F.col("value").cast("double").alias("value"))
    moments = rows.groupBy("node").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    scale = F.when(F.col("s") > 0, F.col("s")) if correlation else F.lit(1.0)
    nodes, times = moments.count(), rows.select("t").distinct().count()
    empty = spark.createDataFrame([], "mode long, node long, eigenvalue double, loading double")
    if not nodes:
        return empty
    long, short = ("node", "t") if nodes > times else ("t", "node")
    width = min(nodes, times)
    if width > MOST_NODES:
        raise ValueError(f"{nodes} nodes by {times} times; the shorter side takes {MOST_NODES} at most")
    names = sorted(r[0] for r in rows.select(short).distinct().collect())
    places = spark.createDataFrame(list(zip(names, range(width), strict=True)), f"{short} long, c int")
    cells = rows.join(moments, "node").select(F.col(long).alias("r"), short, F.coalesce((F.col("value") - F.col("m")) / scale, F.lit(0.0)).alias("x"))
    cells = cells.join(F.broadcast(places), short)  # MOST_NODES short rows
    wide = cut_lineage(cells.groupBy("r").agg(F.collect_list(F.struct("c", "x")).alias("cells")).select("r", F.col("cells.c").alias("c"), F.col("cells.x").alias("x")))

    def dense(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, width))
        at = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("c").offsets.to_numpy()))
        out[at, batch.column("c").flatten().to_numpy()] = batch.column("x").flatten().to_numpy()
        return out

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for a in range(0, batch.num_rows, rows_of_block):
                r = np.linalg.qr(np.concatenate([r, dense(batch.slice(a, rows_of_block))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(r), np.int64)), krylov.packed(r)], names=["g", "x"])

    def stacked(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.stack(pdf["x"].to_numpy()), mode="r")
        return pd.DataFrame({"g": 0, "x": list(r)})

    parts = wide.select("c", "x").mapInArrow(triangle, "g long, x array<double>").withColumn("g", F.spark_partition_id().cast("long"))
    parts = table = cut_lineage(parts)
    while (groups := parts.select("g").distinct().count()) > 8:  # triangles meet in groups of eight
        number = {r.g: k // 8 for k, r in enumerate(parts.select("g").distinct().orderBy("g").collect())}
        named = spark.createDataFrame(list(number.items()), "g long, h long")
        up = parts.join(F.broadcast(named), "g").select(F.col("h").alias("g"), "x")
        up = up.groupBy("g").applyInPandas(lambda key, pdf: stacked(pdf).assign(g=key[0]), "g long, x array<double>")
        parts = table = cut_lineage(up, instead_of=table)
    last = np.array([r.x for r in parts.select("x").collect()])  # eight triangles at most
    _, sigma, vt = np.linalg.svd(np.linalg.qr(last, mode="r"))
    sigma = np.concatenate([sigma, np.zeros(width - len(sigma))])
    value, k = sigma**2 / times, min(count or nodes, width)
    if long == "t":
        v = _signed(vt.T[:, :k])

        def of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from modes_of(batch.column(0), v[batch.column(1).to_numpy()], value)

        return places.select("node", "c").mapInArrow(of_nodes, LOADINGS)
    turn = vt.T[:, :k] / np.where(sigma[:k] > sigma[0] * 1e-14, sigma[:k], np.inf)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from modes_of(batch.column("r"), dense(batch) @ turn, value)

    found = wide.mapInArrow(of_rows, LOADINGS)
    top = found.groupBy("mode").agg(F.max_by("loading", F.struct(F.abs("loading"), -F.col("node"))).alias("top"))  # a row per mode
    return found.join(F.broadcast(top), "mode").select("mode", "node", "eigenvalue", F.when(F.col("top") < 0, -F.col("loading")).otherwise(F.col("loading")).alias("loading"))


LOADINGS = "mode long, node long, eigenvalue double, loading double"


def modes_of(nodes: pa.Array, loadings: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each mode of some nodes."""
    n, k = loadings.shape
    if n and k:
        at = pa.array(np.repeat(np.arange(n), k))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k), n)), nodes.take(at), pa.array(np.tile(value[:k], n)), pa.array(loadings.ravel())], names=["mode", "node", "eigenvalue", "loading"])


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns whose component of greatest size is positive."""
    top = np.abs(v).argmax(axis=0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1, 1)


def principal_components(field: DataFrame, modes: DataFrame) -> DataFrame:
    """(t, mode, pc): anomalies projected on the loadings."""
    mean = field.groupBy("node").agg(F.avg("value").alias("m"))
    return field.join(mean, "node").join(modes, "node").groupBy("t", "mode").agg(F.sum((F.col("value") - F.col("m")) * F.col("loading")).alias("pc"))


def varimax(loadings: DataFrame, normalise: bool = False, tol: float = 1e-5, most: int = 1000) -> DataFrame:
    """(mode, node, loading): Kaiser's rotation of (mode, node, loading), two modes at least; absent loadings are 0.

    A node is a row with its loadings in an array. With B = X R, X' (B^3 - B diag(mean B^2)) is the sum over nodes of
    x b^3, which tasks add up each round, less X'X R diag(diag(R' X'X R)) / N; the rotation alone is on the driver.
    """
    modes = sorted(r[0] for r in loadings.select("mode").distinct().collect())  # a row per mode
    if len(modes) < 2:
        raise ValueError("varimax needs two modes at least")
    cell = [F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("loading"))), F.lit(0.0)) for m in modes]
    rows = loadings.groupBy("node").agg(F.array(*cell).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x)) if normalise else F.lit(1.0)
    rows = rows.withColumn("length", length).withColumn("v", F.when(F.col("length") > 0, F.transform("x", lambda x: x / F.col("length"))).otherwise(F.col("x")))
    basis = cut_lineage(rows.select("node", "v", F.array("length").alias("av")))
    n, gram = basis.count(), krylov.summed(basis, lambda v, av: v.T @ v)
    turn, last = np.eye(len(modes)), 0.0
    for _ in range(most):
        cubes = krylov.summed(basis, lambda v, av, turn=turn: v.T @ (v @ turn) ** 3)
        u, s, v = np.linalg.svd(cubes - gram @ turn * (np.diag(turn.T @ gram @ turn) / n))
        turn = u @ v
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    turned = krylov.mapped(basis, lambda v, av: (v @ turn * av, av)).select("node", F.posexplode("v").alias("c", "loading"))
    names = F.array(*[F.lit(m).cast("long") for m in modes])
    turned = turned.select(F.element_at(names, F.col("c") + 1).alias("mode"), "node", "loading")
    top = turned.groupBy("mode").agg(F.max_by("loading", F.struct(F.abs("loading"), -F.col("node"))).alias("top"))  # a row per mode
    return turned.join(F.broadcast(top), "mode").select("mode", "node", F.when(F.col("top") < 0, -F.col("loading")).otherwise(F.col("loading")).alias("loading"))


def eigenvalues(mat: DataFrame, count: int, which: str = "LM", by: str | None = None) -> DataFrame:
    """(k, re, im): leading eigenvalues in the chosen order, conjugates with positive imaginary part first. With ``by``:
    those of the matrix of each group, a small one (MOST_NODES) that a task holds."""
    if by is None:
        w, _ = krylov.leading(mat.select("i", "j", "w"), count, which)
        return mat.sparkSession.createDataFrame([(k, float(x.real), float(x.imag)) for k, x in enumerate(w)], "k long, re double, im double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        if len(nodes) > MOST_NODES:
            raise ValueError(f"{len(nodes)} nodes in a group; {MOST_NODES} at most")
        m = np.zeros((len(nodes), len(nodes)))
        np.add.at(m, (np.searchsorted(nodes, pdf["i"]), np.searchsorted(nodes, pdf["j"])), pdf["w"].to_numpy(float))
        w = np.linalg.eigvals(m)
        w = w[krylov.ordered(w, which)][:count]
        return pd.DataFrame({"g": pdf["g"].iloc[0], "k": np.arange(len(w)), "re": w.real, "im": w.imag})

    got = mat.withColumn("g", F.col(by).cast("long")).select("g", "i", "j", "w").groupBy("g").applyInPandas(run, "g long, k long, re double, im double")
    return got.withColumnRenamed("g", by)


def damped(mat: DataFrame, damping: float) -> tuple[DataFrame, float]:
    """(matrix, shift): damping * T, T with rows of sum 1 (or none), and what (1 - damping) / N adds to every cell."""
    total = mat.groupBy("i").agg(F.sum("w").alias("s"))
    n = mat.select(F.explode(F.array("i", "j"))).distinct().count()
    return mat.join(total, "i").select("i", "j", F.coalesce(F.try_divide(F.col("w") * damping, "s"), F.lit(0.0)).alias("w")), (1 - damping) / max(1, n)


def left_eigenvectors(mat: DataFrame, count: int = 2, damping: float = 0.85, **how) -> DataFrame:
    """(k, node, re, im, value_re, value_im): leading left eigenpairs of damping * T + (1 - damping) / N, each vector
    scaled to unit sum of sizes; its component of greatest size is positive, so the first one (the stationary vector) is."""
    chain, shift = damped(mat, damping)
    every = mat.select(F.col("i").alias("node")).union(mat.select(F.col("j").alias("node"))).distinct()
    turned = chain.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    w, vectors = krylov.leading(turned, count, "LM", shift, nodes=every, **how)
    values = mat.sparkSession.createDataFrame([(k, float(x.real), float(x.imag)) for k, x in enumerate(w)], "k long, value_re double, value_im double")
    size = F.hypot("re", "im")
    top = vectors.groupBy("k").agg(F.max_by(F.struct("re", "im"), F.struct(F.round(size, 12), -F.col("node"))).alias("top"), F.sum(size).alias("whole")).join(values, "k")  # a row per pair
    length = F.hypot("top.re", "top.im") * F.col("whole")
    re = (F.col("re") * F.col("top.re") + F.col("im") * F.col("top.im")) / length
    im = (F.col("im") * F.col("top.re") - F.col("re") * F.col("top.im")) / length
    return vectors.join(F.broadcast(top), "k").select("k", "node", re.alias("re"), im.alias("im"), "value_re", "value_im")


def left_residuals(mat: DataFrame, pairs: DataFrame, damping: float = 0.85) -> DataFrame:
    """(k, residual): length of v A - lambda v over that of v, for pairs of ``left_eigenvectors``, by joins alone."""
    chain, shift = damped(mat, damping)
    whole = pairs.groupBy("k").agg((F.sum("re") * shift).alias("more_re"), (F.sum("im") * shift).alias("more_im"))
    v = pairs.select("k", F.col("node").alias("i"), "re", "im")
    image = chain.join(v, "i").groupBy("k", F.col("j").alias("node")).agg(F.sum(F.col("w") * F.col("re")).alias("x"), F.sum(F.col("w") * F.col("im")).alias("y"))
    both = pairs.join(image, ["k", "node"], "left").join(F.broadcast(whole), "k")  # a row per pair
    a = F.coalesce("x", F.lit(0.0)) + F.col("more_re") - F.col("re") * F.col("value_re") + F.col("im") * F.col("value_im")
    b = F.coalesce("y", F.lit(0.0)) + F.col("more_im") - F.col("re") * F.col("value_im") - F.col("im") * F.col("value_re")
    return both.groupBy("k").agg(F.sqrt(F.sum(a * a + b * b) / F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("residual"))


def surrogate_spectrum(counts: DataFrame, samples: int, count: int, seed: int = 0) -> DataFrame:
    """(sample, k, re, im): eigenvalues of right-stochastic matrices whose rows of counts were drawn anew."""
    from tidelens.operators.markov import shuffled_counts

    drawn = shuffled_counts(counts, samples, seed)
    total = drawn.groupBy("sample", "i").agg(F.sum("n").alias("s"))
    return eigenvalues(drawn.join(total, ["sample", "i"]).select("sample", "i", "j", (F.col("n") / F.col("s")).alias("w")), count, by="sample")
