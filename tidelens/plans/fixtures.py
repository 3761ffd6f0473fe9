"""Series, fields, networks and states derived from the star-schema and event tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
START = "2024-01-01 00:00:00"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_code(c: str = "event_type") -> F.Column:
    return F.create_map(*[x for k, t in enumerate(EVENT_TYPES) for x in (F.lit(t), F.lit(k).cast("long"))])[F.col(c)]


def series(spark: SparkSession, d: str) -> DataFrame:
    """(series, t, mem): event types of each user in time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select(F.col("user_id").alias("series"), (F.row_number().over(order) - 1).cast("long").alias("t"), event_code().alias("mem"))


def field(spark: SparkSession, d: str, missing: float | None = 0.0) -> DataFrame:
    """(t, node, value): sum of values by hour and event type on the complete grid; cells without events hold ``missing``."""
    hour = F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'{START}', ts)").cast("long")
    got = read(spark, d, "events").groupBy(hour.alias("t"), event_code().alias("node")).agg(F.round(F.sum("value"), 6).alias("value"))
    last = got.agg(F.max("t").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t"))
    grid = last.select("t", F.explode(F.array(*[F.lit(k).cast("long") for k in range(len(EVENT_TYPES))])).alias("node"))
    value = F.col("value") if missing is None else F.coalesce("value", F.lit(missing))
    return grid.join(got, ["t", "node"], "left").select("t", "node", value.alias("value"))


def network(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, w): quantity shipped from supplier nations to customer nations."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("j"))
    supplier = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("i"))
    return line.join(orders, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").groupBy("i", "j").agg(F.sum("l_quantity").alias("w"))


def sparse_network(spark: SparkSession, d: str) -> DataFrame:
    """The entries above the mean."""
    n = network(spark, d)
    return n.crossJoin(F.broadcast(n.agg(F.avg("w").alias("m")))).filter("w > m").select("i", "j", "w")


def members(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_regionkey") + 1).cast("long").alias("com"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).select("node")


def shares(spark: SparkSession, d: str) -> DataFrame:
    """(node, p): each supplier nation's share of the network's weight."""
    n = network(spark, d)
    return n.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("s")).crossJoin(F.broadcast(n.agg(F.sum("w").alias("ss")))).select("node", (F.col("s") / F.col("ss")).alias("p"))


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (k * 14 - 168).alias("lon"), (k * 6 - 72).alias("lat"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """(t, node, value): orders by month since 1995-01 and priority."""
    t = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("long")
    return read(spark, d, "orders").groupBy(t.alias("t"), (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("node")).agg(F.count("*").cast("double").alias("value"))


def states(spark: SparkSession, d: str) -> DataFrame:
    """(series, t, x, y): hour of day and capped value of each user's events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select(F.col("user_id").alias("series"), (F.row_number().over(order) - 1).cast("long").alias("t"), F.hour("ts").cast("double").alias("x"), F.least(F.floor("value"), F.lit(100)).cast("double").alias("y"))


CODE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(EVENT_TYPES)) + " END::BIGINT"
CTE = {
    "f1": f"f1 AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, {CODE} AS mem FROM events)",
    "g2": f"g2 AS (SELECT (date_diff('second', TIMESTAMP '{START}', ts) // 3600)::BIGINT AS t, {CODE} AS node, round(sum(value), 6) AS value FROM events GROUP BY 1, 2), grid2 AS (SELECT t::BIGINT AS t, node::BIGINT AS node FROM (SELECT unnest(generate_series(0, (SELECT max(t) FROM g2))) AS t), (SELECT unnest([0, 1, 2, 3, 4]) AS node))",
    "f2": "f2 AS (SELECT grid2.t, grid2.node, coalesce(value, 0e0) AS value FROM grid2 LEFT JOIN g2 USING (t, node))",
    "f2n": "f2n AS (SELECT grid2.t, grid2.node, value FROM grid2 LEFT JOIN g2 USING (t, node))",
    "f3": "f3 AS (SELECT s_nationkey::BIGINT AS i, c_nationkey::BIGINT AS j, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    "f3t": "f3t AS (SELECT * FROM f3 WHERE w > (SELECT avg(w) FROM f3))",
    "com": "com AS (SELECT n_nationkey::BIGINT AS node, (n_regionkey + 1)::BIGINT AS com FROM nation)",
    "u3": "u3 AS (SELECT i AS node, sum(w) / (SELECT sum(w) FROM f3) AS p FROM f3 GROUP BY 1)",
    "t3": "t3 AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM f3)",
    "f5": "f5 AS (SELECT n_nationkey::BIGINT AS node, n_nationkey * 14e0 - 168e0 AS lon, n_nationkey * 6e0 - 72e0 AS lat FROM nation)",
    "f6": "f6 AS (SELECT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::BIGINT AS t, substr(o_orderpriority, 1, 1)::BIGINT - 1 AS node, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2)",
    "f7": "f7 AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, hour(ts)::DOUBLE AS x, least(floor(value), 100)::DOUBLE AS y FROM events)",
}
NEEDS = {"f2": ("g2",), "f2n": ("g2",), "f3t": ("f3",), "u3": ("f3",), "t3": ("f3",)}


def sql(uses: str, body: str, more: str = "") -> str:
    """A query over the named CTEs (and those that they need), further CTEs, and a body."""
    names: list[str] = []
    for u in uses.split():
        for n in (*NEEDS.get(u, ()), u):
            if n not in names:
                names.append(n)
    return "WITH " + ", ".join([CTE[n] for n in names] + ([more] if more else [])) + " " + body
