"""Sparse matrices as (i, j, w) frames: normalisers, reductions, edits and products. Absent entries are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.functions.scalar import ratio


def summed(mat: DataFrame) -> DataFrame:
    """Duplicates added up, as triplet constructors do."""
    return mat.groupBy("i", "j").agg(F.sum("w").alias("w"))


def sums(mat: DataFrame, axis: str, nodes: DataFrame | None = None) -> DataFrame:
    """(node, s): sums of rows (axis 'i') or columns ('j'); with ``nodes`` (node), 0 for empty ones."""
    got = mat.groupBy(F.col(axis).alias("node")).agg(F.sum("w").alias("s"))
    return got if nodes is None else nodes.select("node").join(got, "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("s"))


def stochastic(mat: DataFrame, axis: str) -> DataFrame:
    """Rows ('i', right-stochastic), columns ('j', left-stochastic) or the whole ('all') scaled to sum 1; rows or
    columns of sum 0 keep their entries."""
    if axis == "all":
        total = mat.agg(F.sum("w").alias("s"))
        return mat.crossJoin(F.broadcast(total)).select("i", "j", F.coalesce(ratio("w", "s"), "w").alias("w"))  # one row
    key = sums(mat, axis).withColumnRenamed("node", axis)
    return mat.join(key, axis).select("i", "j", F.coalesce(ratio("w", "s"), "w").alias("w"))


def scaled_by(mat: DataFrame, vector: DataFrame, axis: str, power: float = 1.0) -> DataFrame:
    """w times p(node)^power of the entry's row or column; entries of nodes without p vanish."""
    p = vector.select(F.col("node").alias(axis), F.col("p").alias("__p"))
    factor = F.when(F.col("__p") > 0, F.pow("__p", F.lit(power))) if power != 1.0 else F.col("__p")
    return mat.join(p, axis).select("i", "j", (F.col("w") * factor).alias("w")).filter(F.col("w").isNotNull())


def normalised_rows(mat: DataFrame, row_sums: DataFrame) -> DataFrame:
    """Rows divided by given sums (node, s) where these are not 0."""
    key = row_sums.select(F.col("node").alias("i"), "s")
    return mat.join(key, "i", "left").select("i", "j", F.coalesce(ratio("w", "s"), "w").alias("w"))


def normalised_vector(vector: DataFrame) -> DataFrame:
    total = vector.agg(F.sum("p").alias("s"))
    return vector.crossJoin(F.broadcast(total)).select("node", ratio("p", "s").alias("p"))


def filter_weak(mat: DataFrame, row_weight: DataFrame, col_weight: DataFrame, alpha: float, norm: str | None = None) -> DataFrame:
    """Entries whose row and column weights (node, p) both reach ``alpha``, then normalised along ``norm``."""
    strong = lambda v, axis: v.filter(F.col("p") >= alpha).select(F.col("node").alias(axis))
    kept = mat.join(strong(row_weight, "i"), "i", "left_semi").join(strong(col_weight, "j"), "j", "left_semi").select("i", "j", "w")
    return kept if norm is None else stochastic(kept, norm)


def clamped(mat: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return mat.withColumn("w", F.greatest(F.lit(low), F.least(F.lit(high), F.col("w"))))


def compared(mat: DataFrame, ref: float, greater: bool = True) -> DataFrame:
    """(i, j, b) on stored entries."""
    return mat.select("i", "j", (F.col("w") > ref if greater else F.col("w") < ref).alias("b"))


def any_true(flags: DataFrame) -> DataFrame:
    return flags.agg(F.coalesce(F.bool_or("b"), F.lit(False)).alias("any_b"))


def extremes(mat: DataFrame) -> DataFrame:
    """One row: least and greatest stored value, where the greatest is first in column order, stored count, sum."""
    at = lambda c: F.max_by(c, F.struct("w", -F.col("j"), -F.col("i")))
    return mat.agg(F.min("w").alias("min_w"), F.max("w").alias("max_w"), at("i").alias("arg_i"), at("j").alias("arg_j"), F.count("*").alias("nnz"), F.sum("w").alias("sum_w"))


def scaled_line(mat: DataFrame, axis: str, k: int, factor: float) -> DataFrame:
    return mat.withColumn("w", F.when(F.col(axis) == k, F.col("w") * factor).otherwise(F.col("w")))


def replaced_line(mat: DataFrame, axis: str, k: int, line: DataFrame) -> DataFrame:
    """Row or column ``k`` overwritten by ``line`` (node, p)."""
    other = "j" if axis == "i" else "i"
    new = line.select(F.lit(k).cast("long").alias(axis), F.col("node").alias(other), F.col("p").alias("w"))
    return mat.filter(F.col(axis) != k).unionByName(new)


def added_line(mat: DataFrame, axis: str, source: int, target: int) -> DataFrame:
    """Row or column ``source`` added to ``target``; the source stays."""
    copy = mat.filter(F.col(axis) == source).withColumn(axis, F.lit(target).cast("long"))
    return summed(mat.unionByName(copy))


def transposed(mat: DataFrame) -> DataFrame:
    return mat.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("w").alias("wa"))
    right = b.select(F.col("i").alias("k"), "j", F.col("w").alias("wb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def vector_product(vector: DataFrame, mat: DataFrame) -> DataFrame:
    """(node, p): the row vector times the matrix."""
    v = vector.select(F.col("node").alias("i"), "p")
    return mat.join(v, "i").groupBy(F.col("j").alias("node")).agg(F.sum(F.col("p") * F.col("w")).alias("p"))


def upper_triangle(mat: DataFrame) -> DataFrame:
    """What symmetric storage keeps of a symmetric matrix."""
    return mat.filter("i <= j")


def from_upper_triangle(upper: DataFrame) -> DataFrame:
    """The symmetric matrix that ``upper_triangle`` stores."""
    return upper.unionByName(upper.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def constant_vector(nodes: DataFrame, value: float) -> DataFrame:
    return nodes.select("node", F.lit(float(value)).alias("p"))


def linspaced_vector(n: int, low: float, high: float, spark) -> DataFrame:
    """(node, p): n evenly spaced numbers from ``low`` to ``high``, the only one being ``low``."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("node"), (F.lit(float(low)) + F.col("id") * F.lit(step)).alias("p"))


def lower_pairs(n: int, spark) -> DataFrame:
    """(i, j) with i > j below n."""
    a, b = spark.range(n).select(F.col("id").alias("i")), spark.range(n).select(F.col("id").alias("j"))
    return b.join(a, a.i > b.j).select("i", "j")
