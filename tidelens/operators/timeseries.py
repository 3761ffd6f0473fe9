"""Time-series statistics on fields (t, node, value): lags, correlations, anomalies, embeddings, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.scalar import persistence, ratio, safe_corr


def missing_to_null(field: DataFrame, sentinel: float, tolerance: float = 0.0) -> DataFrame:
    return field.withColumn("value", F.when(F.abs(F.col("value") - F.lit(sentinel)) > tolerance, F.col("value")))


def anomaly(field: DataFrame, cycle: int) -> DataFrame:
    """Value minus the mean of its node and phase t mod cycle."""
    phase = field.withColumn("phase", F.pmod("t", F.lit(cycle)))
    mean = phase.groupBy("node", "phase").agg(F.avg("value").alias("mean"))
    return phase.join(mean, ["node", "phase"]).select("t", "node", (F.col("value") - F.col("mean")).alias("value"))


def standardised(field: DataFrame) -> DataFrame:
    """(value - mean) / population deviation of its node; null for constant nodes."""
    moments = field.groupBy("node").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return field.join(moments, "node").select("t", "node", ratio(F.col("value") - F.col("m"), "s").alias("value"))


def select_phases(field: DataFrame, phases: list[int], cycle: int) -> DataFrame:
    """Rows of the chosen phases, in whole cycles from t = 0 only."""
    whole = field.agg((F.floor((F.max("t") + 1) / cycle) * cycle).alias("until"))
    return field.crossJoin(F.broadcast(whole)).filter((F.col("t") < F.col("until")) & F.pmod("t", F.lit(cycle)).isin(phases)).drop("until")


def lag_autocorrelation(field: DataFrame, lag: int = 1) -> DataFrame:
    """(node, a): Pearson correlation of the values ``lag`` rows apart, each part with its own mean, nulls skipped pairwise."""
    later = F.lead("value", lag).over(Window.partitionBy("node").orderBy("t"))
    return field.withColumn("later", later).groupBy("node").agg(safe_corr("value", "later").alias("a"))


def persistence_times(field: DataFrame, lag: int = 1) -> DataFrame:
    return lag_autocorrelation(field, lag).select("node", persistence("a", lag).alias("tau"))


def cross_correlation(x: DataFrame, y: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, i, j, r): X_i at t with Y_j at t + lag, for all nodes; shifted before the join, so that it is on plain keys."""
    left = x.select("t", F.col("node").alias("i"), F.col("value").alias("x")).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("u", F.col("t") + F.col("lag"))
    right = y.select(F.col("t").alias("u"), F.col("node").alias("j"), F.col("value").alias("y"))
    return left.join(right, "u").groupBy("lag", "i", "j").agg(safe_corr("x", "y").alias("r"))


def pair_values(field: DataFrame) -> DataFrame:
    """(t, i, j, x, y) for nodes i < j."""
    left, right = field.select("t", F.col("node").alias("i"), F.col("value").alias("x")), field.select("t", F.col("node").alias("j"), F.col("value").alias("y"))
    return left.join(right, "t").filter("i < j")


def pearson_pairs(field: DataFrame) -> DataFrame:
    return pair_values(field).groupBy("i", "j").agg(safe_corr("x", "y").alias("r"))


def uncentred_covariance(field: DataFrame) -> DataFrame:
    """sum x y / (n - 1), means not removed."""
    return pair_values(field).groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) / (F.count(F.col("x") * F.col("y")) - 1)).alias("c"))


def _lagged_mean(first: DataFrame, second: DataFrame, most_lag: int, scale: bool) -> DataFrame:
    def centred(series: DataFrame, name: str) -> DataFrame:
        m = series.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
        z = ratio(F.col("value") - F.col("m"), "s") if scale else F.col("value") - F.col("m")
        return series.crossJoin(F.broadcast(m)).select("t", z.alias(name))

    left = centred(first, "x").withColumn("lag", F.explode(F.sequence(F.lit(-most_lag), F.lit(most_lag)))).withColumn("u", F.col("t") + F.col("lag"))
    right = centred(second, "y").withColumnRenamed("t", "u")
    return left.join(right, "u").groupBy("lag").agg(F.avg(F.col("x") * F.col("y")).alias("c"))


def ccf(first: DataFrame, second: DataFrame, most_lag: int) -> DataFrame:
    """(lag, c): mean over the overlap of z1(t) z2(t + lag), both standardised over all of their values."""
    return _lagged_mean(first, second, most_lag, True)


def ccovf(first: DataFrame, second: DataFrame, most_lag: int) -> DataFrame:
    return _lagged_mean(first, second, most_lag, False)


def delay_embedding(series: DataFrame, delays: list[int], by: str = "node") -> DataFrame:
    """(node, t, x0, x1, ...): the value and its lagged copies, where all exist."""
    order = Window.partitionBy(by).orderBy("t")
    cols = [F.col("value").alias("x0")] + [F.lag("value", d).over(order).alias(f"x{k}") for k, d in enumerate(delays, 1)]
    rank = F.row_number().over(order)
    return series.select(by, "t", *cols, rank.alias("rank")).filter(F.col("rank") > max(delays)).drop("rank")


def histogram_range(field: DataFrame) -> DataFrame:
    return field.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def binned(field: DataFrame, bins: int) -> DataFrame:
    """Adds ``bin`` in 0..bins-1 over the common range; the last bin is closed."""
    share = ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    return field.filter("value is not null").crossJoin(F.broadcast(histogram_range(field))).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("long")).drop("lo", "hi")


def bin_entropy(b: DataFrame) -> DataFrame:
    """(node, h): entropy in nats of each node's bins."""
    own = b.groupBy("node", "bin").agg(F.count("*").alias("n"))
    total = own.groupBy("node").agg(F.sum("n").alias("nn"))
    return own.join(total, "node").groupBy("node").agg((-F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") / F.col("nn")))).alias("h"))


def mutual_information(field: DataFrame, bins: int, other: DataFrame | None = None) -> DataFrame:
    """(i, j, mi) in nats from histograms over the common range of a field: for i <= j, where i = j gives the entropy, or
    for all pairs of a node of ``field`` and one of ``other``, which has a range of its own."""
    b = binned(field, bins)
    c = b if other is None else binned(other, bins)
    h, k = bin_entropy(b), bin_entropy(c)
    left, right = b.select("t", F.col("node").alias("i"), F.col("bin").alias("bi")), c.select("t", F.col("node").alias("j"), F.col("bin").alias("bj"))
    met = left.join(right, "t")
    joint = (met.filter("i <= j") if other is None else met).groupBy("i", "j", "bi", "bj").agg(F.count("*").alias("n"))
    both = joint.groupBy("i", "j").agg(F.sum("n").alias("nn"))
    hij = joint.join(both, ["i", "j"]).groupBy("i", "j").agg((-F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") / F.col("nn")))).alias("hij"))
    hi, hj = h.select(F.col("node").alias("i"), F.col("h").alias("hi")), k.select(F.col("node").alias("j"), F.col("h").alias("hj"))
    return hij.join(hi, "i").join(hj, "j").select("i", "j", (F.col("hi") + F.col("hj") - F.col("hij")).alias("mi"))


def inverse_ecdf(field: DataFrame, shares: list[float], bins: int = 10) -> DataFrame:
    """(p, x): inverse of a cumulative histogram whose range is widened by half a bin, linear between bin centres."""
    r = histogram_range(field).withColumn("half", (F.col("hi") - F.col("lo")) / (2.0 * (bins - 1))).select((F.col("lo") - F.col("half")).alias("lo"), (F.col("hi") + F.col("half")).alias("hi"), ((F.col("hi") - F.col("lo") + 2 * F.col("half")) / bins).alias("width"))
    bin_of = F.least(F.lit(bins - 1), F.floor(F.coalesce(ratio(F.col("value") - F.col("lo"), "width"), F.lit(0.0)))).cast("long")
    counts = field.filter("value is not null").crossJoin(F.broadcast(r)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    grid = field.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").crossJoin(F.broadcast(r))  # one row per bin
    total = counts.agg(F.sum("n").alias("nn"))
    order = Window.orderBy("bin")
    cdf = grid.crossJoin(F.broadcast(total)).select("bin", (F.sum(F.coalesce("n", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("nn")).alias("c"), (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("x"))
    steps = cdf.select("bin", "c", "x", F.lead("c").over(order).alias("c1"), F.lead("x").over(order).alias("x1"))
    p = field.sparkSession.createDataFrame([(float(s),) for s in shares], "p double")
    inner = p.join(F.broadcast(steps), (F.col("p") >= F.col("c")) & (F.col("p") < F.col("c1"))).select("p", (F.col("x") + (F.col("p") - F.col("c")) / (F.col("c1") - F.col("c")) * (F.col("x1") - F.col("x"))).alias("x"))
    ends = cdf.agg(F.min_by("c", "bin").alias("c_low"), F.min_by("x", "bin").alias("x_low"), F.max_by("c", "bin").alias("c_high"), F.max_by("x", "bin").alias("x_high"))
    outer = p.crossJoin(ends).filter("p < c_low or p >= c_high").select("p", F.when(F.col("p") < F.col("c_low"), F.col("x_low")).otherwise(F.col("x_high")).alias("x"))
    return inner.unionByName(outer)


def find_first(field: DataFrame, value: Column | float | str) -> DataFrame:
    """(node, t) of the first row of each node with this value; nodes without any are absent."""
    return field.filter(F.col("value") == (value if isinstance(value, Column) else F.lit(value))).groupBy("node").agg(F.min("t").alias("t"))


def unique_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def community_series(field: DataFrame, members: DataFrame, outlier: float = 1e6) -> DataFrame:
    """(t, com, value): mean series of the communities above 0, values beyond ``outlier`` left out."""
    return field.filter(F.abs("value") <= outlier).join(members.filter("com > 0"), "node").groupBy("t", "com").agg(F.avg("value").alias("value"))


def community_correlation(field: DataFrame, members: DataFrame) -> DataFrame:
    return pearson_pairs(community_series(field, members).withColumnRenamed("com", "node"))
