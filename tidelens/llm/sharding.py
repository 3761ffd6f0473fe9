"""Sharding by sampled splitters, with DataFrame functions only.

Law ``bytes``: shards get near-equal bytes. Records are put in the order of a key (60 bits of the text's MD5, then id,
then place of the row, so that equal texts lie side by side and no two records tie). A size-weighted key sample gives the
quantile boundaries of ranges; exact totals of all ranges, over all rows, tell which are overfull, and these are
subdivided at boundaries of a denser sample of their own. Within a range, running sums give each record its exact
place in the whole order, and so its shard and its slot. With ``together`` (the query sets it), a group of equal texts in
which a boundary falls goes as a whole to the shard that its middle is in, unless it has more bytes than a shard's share;
a boundary so moves by half such a group at most. Work per task is one range, however hot a text is; only the
table of ranges (a few numbers per range) is brought together.

Defined cases: null text has no bytes (size 8, crc32 of nothing, 0); a null id stays null and comes before others among
equal texts; repeated rows are separate records; texts of any
length are one record; equal texts stay in one shard unless a boundary falls among them (with ``together``: unless they
have more bytes than a shard's share); fewer records than shards leave shards empty; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

KEY = ("h", "doc_id", "row")


def key(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in KEY])


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, h, row): what sharding needs of a document, without its text."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.conv(F.substring(F.md5(raw), 1, 15), 16, 10).cast("long").alias("h"), F.monotonically_increasing_id().alias("row"))


def in_order(keys: Iterable[tuple]) -> list[tuple]:
    """Distinct keys in the order of Spark, where nulls come first."""
    return sorted(set(keys), key=lambda k: tuple((x is not None, x or 0) for x in k))


def sampled(rows: DataFrame, per_byte: Column) -> DataFrame:
    """Keys drawn with probability size * per_byte (at most 1), decided by a hash of the key."""
    uniform = F.pmod(F.xxhash64(F.lit(1), *[F.col(c) for c in KEY]), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.filter(uniform < F.col("size") * per_byte)


def located(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``rows`` with ``range``, the number of splitters at or below the key.

    Two steps keep the work per row near the square root of the number of splitters: a few coarse splitters, then
    the fine ones of that part.
    """
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    step = max(1, round(len(splitters) ** 0.5))
    parts = [splitters[a : a + step] for a in range(0, len(splitters), step)]
    spark = rows.sparkSession
    packed = spark.createDataFrame([([tuple(p[0]) for p in parts], [[tuple(k) for k in p] for p in parts])], "coarse array<struct<h:long,doc_id:long,row:long>>, fine array<array<struct<h:long,doc_id:long,row:long>>>")
    part = F.size(F.filter("coarse", lambda s: s <= key()))
    inside = F.size(F.filter(F.element_at("fine", F.greatest(F.lit(1), F.col("part"))), lambda s: s <= key()))
    return rows.crossJoin(F.broadcast(packed)).withColumn("part", part).withColumn("range", F.when(F.col("part") == 0, 0).otherwise((F.col("part") - 1) * step + inside)).drop("part", "coarse", "fine")


def splitters_of(rows: DataFrame, total: int, ranges: int, per_range: int = 32) -> list[tuple]:
    """Quantile boundaries of a size-weighted sample of about ``ranges * per_range`` keys, for ``ranges`` ranges."""
    if ranges < 2 or not total:
        return []
    keys = in_order(tuple(r) for r in sampled(rows, F.lit(ranges * per_range / total)).select(*KEY).collect())
    return in_order(keys[len(keys) * i // ranges] for i in range(1, ranges)) if keys else []


def shard_of(twice_middle: Column, shards: int, total: int) -> Column:
    """The shard that the middle of a run of bytes is in."""
    return F.least(F.lit(shards - 1), F.floor(twice_middle.cast("decimal(38,0)") * shards / max(1, 2 * total)).cast("int"))


def whole_groups(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """``placed`` with the groups of equal texts that a boundary divides put into one shard, if none is larger than a
    shard's share. Each boundary falls in one group at most, so these are fewer than the shards."""
    ends = placed.groupBy("shard").agg(F.min_by("h", "place").alias("first"), F.max_by("h", "place").alias("last")).collect()
    divided = sorted({e.last for e in ends} & {e.first for e in ends})
    groups = placed.filter(F.col("h").isin(divided)).groupBy("h").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b"), F.min("shard").alias("least"), F.max("shard").alias("most"))
    groups = groups.filter((F.col("least") < F.col("most")) & ((F.col("b") - F.col("a")) * shards <= total)).select("h", shard_of(F.col("a") + F.col("b"), shards, total).alias("own"))
    return placed.join(F.broadcast(groups), "h", "left").withColumn("shard", F.coalesce("own", "shard")).drop("own")


def shard(docs: DataFrame, shards: int = 24, range_bytes: int = 64 << 20, least_ranges: int = 4, most_ranges: int = 4096, id_col: str = "doc_id", text_col: str = "text", together: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The number of ranges follows the bytes up to ``most_ranges``, which bounds the key sample (32 keys a range).
    """
    rows = materialise(records(docs, id_col, text_col), "shard-records")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(shards * least_ranges, min(most_ranges, -(-total // range_bytes)))
    goal = max(1, total // ranges)
    splitters = splitters_of(rows, total, ranges)
    for _ in range(4):  # overfull ranges are subdivided at boundaries of a denser sample
        ranged = located(rows, splitters)
        totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
        over = {r.range: -(-r.bytes // goal) for r in totals if r.bytes > 2 * goal + r.largest and r.n > 1}
        if not over:
            break
        rates = rows.sparkSession.createDataFrame([(k, 32.0 * v / t) for k, v in over.items() for t in [next(r.bytes for r in totals if r.range == k)]], "range int, rate double")
        denser = sampled(ranged.join(F.broadcast(rates), "range"), F.col("rate")).select("range", *KEY)
        per = denser.groupBy("range").agg(F.array_sort(F.collect_list(key())).alias("k")).collect()
        more = {tuple(r.k[len(r.k) * i // over[r.range]]) for r in per for i in range(1, over[r.range])}
        splitters = in_order([*splitters, *more])
    ends = {r.range: (r.bytes, r.n) for r in totals}
    before, offsets = (0, 0), []
    for k in sorted(ends):
        offsets.append((k, *before))
        before = (before[0] + ends[k][0], before[1] + ends[k][1])
    offsets = rows.sparkSession.createDataFrame(offsets, "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy(*KEY)
    placed = (
        ranged.withColumn("bytes_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("rows_in", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "range")  # one short row per range
        .withColumn("start", F.col("bytes_before") + F.col("bytes_in"))
        .withColumn("shard", shard_of(F.col("start") * 2 + F.col("size"), shards, total))
        .withColumn("place", F.col("rows_before") + F.col("rows_in"))
    )
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "h", "start", "shard", "place"), "shard-places")
    placed = whole_groups(placed, shards, total) if together else placed
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), together=True)
