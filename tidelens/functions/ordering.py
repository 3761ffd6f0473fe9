"""Places and running sums of rows in an order, without one task for all: ranges of the order, totals of the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.storage import cut_lineage

WITHIN = 33  # bits of monotonically_increasing_id that number the rows of a partition


def placed(rows: DataFrame, *order: Column | str, sums: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``place`` (0, 1, ... in the order) and, for each name of ``sums``, the sum of that column over the
    earlier rows. Rows are dealt in ranges of the order and written; running values within a range are moved by the totals
    of the ranges before it, a row per range. Ties lie in any order, but lie in the same one for all that follows."""
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    kept = cut_lineage(dealt.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, sums = F.shiftright("__at", WITHIN), sums or {}
    totals = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(sums.values())])
    before, offsets = [0] + [0.0] * len(sums), []
    for r in totals.orderBy("part").collect():  # a row per range
        offsets.append((r.part, *before))
        before = [b + (x or 0) for b, x in zip(before, r[1:], strict=True)]
    schema = "__part long, __before long" + "".join(f", __s{k} double" for k in range(len(sums)))
    moved = kept.withColumn("__part", part).join(F.broadcast(rows.sparkSession.createDataFrame(offsets, schema)), "__part")
    earlier = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    running = {name: F.col(f"__s{k}") + F.coalesce(F.sum(F.col(c)).over(earlier), F.lit(0.0)) for k, (name, c) in enumerate(sums.items())}
    at = F.col("__at").bitwiseAND((1 << WITHIN) - 1) + F.col("__before")
    return moved.select(*rows.columns, at.alias("place"), *[c.alias(name) for name, c in running.items()])
