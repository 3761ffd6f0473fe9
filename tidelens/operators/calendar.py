"""Date ranges as YYYYMMDD strings, in the common calendar and in one of 365-day years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUT = "yyyyMMdd"


def date_range(spans: DataFrame, step: int = 1, layout: str = LAYOUT) -> DataFrame:
    """(id, k, day) from ``spans`` (id, first, last of DATE): every ``step`` days, both ends included."""
    days = spans.select("id", F.posexplode(F.sequence("first", "last", F.expr(f"interval {step} days"))).alias("k", "d"))
    return days.select("id", F.col("k").cast("long").alias("k"), F.date_format("d", layout).alias("day"))


def noleap_number(d: Column) -> Column:
    """Days since year 0 in a calendar without 29 February (which counts as 28 February)."""
    after = (F.dayofyear(d) > 59) & (F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366)
    return F.year(d).cast("long") * 365 + F.dayofyear(d) - 1 - F.when(after, 1).otherwise(0)


def noleap_day(number: Column) -> Column:
    """YYYYMMDD of such a number; any common year gives month and day."""
    year = F.floor(number / 365)
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (number - year * 365).cast("int")), "MMdd"))


def date_range_noleap(spans: DataFrame, step: int = 1) -> DataFrame:
    low, high = noleap_number(F.col("first")), noleap_number(F.col("last"))
    return spans.select("id", F.posexplode(F.sequence(low, high, F.lit(step).cast("long"))).alias("k", "n")).select("id", F.col("k").cast("long").alias("k"), noleap_day(F.col("n")).alias("day"))


def date_range_year_reset(spans: DataFrame, step: int = 1, layout: str = LAYOUT) -> DataFrame:
    """Like ``date_range``, but each later year starts anew on its first day."""
    years = spans.select("id", "last", F.explode(F.sequence(F.year("first"), F.year("last"))).alias("y"), "first")
    begin = F.greatest("first", F.make_date("y", F.lit(1), F.lit(1)))
    end = F.least("last", F.make_date("y", F.lit(12), F.lit(31)))
    days = years.select("id", F.explode(F.sequence(begin, end, F.expr(f"interval {step} days"))).alias("d"))
    return days.select("id", F.date_format("d", layout).alias("day"))


def permutations(rows: DataFrame, by: str = "id", value: str = "v", most: int = 8) -> DataFrame:
    """(id, k, perm): all orders of the distinct values of each group, k counting them in lexicographic order.

    Grown a place at a time by projections alone; groups of more than ``most`` values are an error.
    """
    kind = rows.schema[value].dataType.simpleString()
    sets = rows.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("all"))
    checked = F.when(F.size("all") <= most, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {most} values")).cast(f"array<{kind}>"))
    grown = sets.select(by, checked.alias("all"), F.array().cast(f"array<{kind}>").alias("perm"), F.lit(0).cast("long").alias("k"))
    for _ in range(most):
        left = F.array_except("all", "perm")
        grown = grown.select(by, "all", "perm", (F.col("k") * F.greatest(F.size(left), F.lit(1))).alias("k"), F.posexplode_outer(left).alias("place", "v"))
        grown = grown.select(by, "all", F.when(F.col("v").isNull(), F.col("perm")).otherwise(F.concat("perm", F.array("v"))).alias("perm"), (F.col("k") + F.coalesce("place", F.lit(0))).alias("k"))
    return grown.select(by, "k", "perm")
