"""The registered queries of the operators over the given tables, with the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions.scalar import gaussian_entropy
from tidelens.operators import markov as mk
from tidelens.operators import matrix as mx
from tidelens.operators import network as nw
from tidelens.operators import timeseries as ts
from tidelens.operators.partition import two_level_codelength
from tidelens.plans import fixtures as fx
from tidelens.plans.fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if text is not None:
            SQL[name or f.__name__] = text
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r9(c: Column | str, name: str) -> Column:
    return F.round(c, 9).alias(name)


# Markov core


@query(sql("f1", "SELECT i, j, n, round(n / sum(n) OVER (), 9) AS joint, round(n / sum(n) OVER (PARTITION BY j), 9) AS p_backcast, round(n / sum(n) OVER (PARTITION BY i), 9) AS q_forecast FROM c", "p AS (SELECT mem AS i, lead(mem) OVER (PARTITION BY series ORDER BY t) AS j FROM f1), c AS (SELECT i, j, count(*) AS n FROM p WHERE j IS NOT NULL GROUP BY 1, 2)"))
def transition_matrix(spark, d):
    return rounded(mk.transition_matrix(fx.series(spark, d)), "joint", "p_backcast", "q_forecast")


@query(sql("f1", "SELECT i, j, count(*) AS n FROM p WHERE j IS NOT NULL GROUP BY 1, 2", "p AS (SELECT mem AS i, lead(mem, 3) OVER (PARTITION BY series ORDER BY t) AS j FROM f1)"))
def transition_counts_tau3(spark, d):
    return mk.transition_counts(fx.series(spark, d), 3)


@query(sql("f1", "SELECT node, round(sum(a) / (SELECT count(*) FROM p WHERE j IS NOT NULL), 9) AS init, round(sum(b) / (SELECT count(*) FROM p WHERE j IS NOT NULL), 9) AS final FROM (SELECT i AS node, 1 AS a, 0 AS b FROM p WHERE j IS NOT NULL UNION ALL SELECT j, 0, 1 FROM p WHERE j IS NOT NULL) GROUP BY 1", "p AS (SELECT mem AS i, lead(mem) OVER (PARTITION BY series ORDER BY t) AS j FROM f1)"))
def init_final_dist(spark, d):
    return rounded(mk.end_distributions(fx.series(spark, d)), "init", "final")


@query(sql("f1", "SELECT count(*) AS pairs, round(avg(CASE WHEN i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 3 THEN 0e0 ELSE 1e0 END), 9) AS lost FROM p WHERE j IS NOT NULL", "p AS (SELECT mem AS i, lead(mem) OVER (PARTITION BY series ORDER BY t) AS j FROM f1)"))
def lost_share(spark, d):
    return rounded(mk.lost_share(mk.lagged_pairs(fx.series(spark, d)), 4), "lost")


@query(sql("f3", "SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 9) AS w FROM f3"))
def right_stochastic(spark, d):
    return rounded(mx.stochastic(fx.network(spark, d), "i"), "w")


@query(sql("f3", "SELECT i, j, round(w / sum(w) OVER (PARTITION BY j), 9) AS w FROM f3"))
def left_stochastic(spark, d):
    return rounded(mx.stochastic(fx.network(spark, d), "j"), "w")


@query(sql("f3", "SELECT i, j, round(w / sum(w) OVER (), 12) AS w FROM f3"))
def and_stochastic(spark, d):
    return rounded(mx.stochastic(fx.network(spark, d), "all"), "w", digits=12)


@query(sql("f3 com", "SELECT node, coalesce(sum(w), 0e0) AS s FROM com LEFT JOIN f3 ON i = node GROUP BY 1"))
def row_sums(spark, d):
    return mx.sums(fx.network(spark, d), "i", fx.nodes(spark, d))


@query(sql("f3 com", "SELECT node, coalesce(sum(w), 0e0) AS s FROM com LEFT JOIN f3 ON j = node GROUP BY 1"))
def col_sums(spark, d):
    return mx.sums(fx.network(spark, d), "j", fx.nodes(spark, d))


@query(sql("f3 u3", "SELECT f3.i, f3.j, round(f3.w / r.s, 9) AS w FROM f3 JOIN (SELECT i, sum(w) AS s FROM f3 GROUP BY 1) r USING (i)"))
def normalized_rows(spark, d):
    n = fx.network(spark, d)
    return rounded(mx.normalised_rows(n, mx.sums(n, "i")), "w")


@query(sql("f3 u3", "SELECT node, round(p * 3e0 / (SELECT sum(p * 3e0) FROM u3), 9) AS p FROM u3"))
def normalized_vector(spark, d):
    return rounded(mx.normalised_vector(fx.shares(spark, d).withColumn("p", F.col("p") * 3)), "p")


WEAK = "rw AS (SELECT i AS node, sum(w) / (SELECT sum(w) FROM f3) AS p FROM f3 GROUP BY 1), cw AS (SELECT j AS node, sum(w) / (SELECT sum(w) FROM f3) AS p FROM f3 GROUP BY 1), k AS (SELECT f3.* FROM f3 JOIN rw ON rw.node = i JOIN cw ON cw.node = j WHERE rw.p >= 0.03e0 AND cw.p >= 0.03e0)"


@query(sql("f3", "SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 9) AS w FROM k", WEAK))
def filter_transition(spark, d):
    n = fx.network(spark, d)
    weight = lambda axis: mx.normalised_vector(mx.sums(n, axis).withColumnRenamed("s", "p"))
    return rounded(mx.filter_weak(n, weight("i"), weight("j"), 0.03, "i"), "w")


@query(sql("u3", "SELECT round(-sum(p * log2(p)), 9) AS h FROM u3"))
def entropy_bits(spark, d):
    return rounded(mk.entropy(fx.shares(spark, d)), "h")


@query(sql("t3 u3", "SELECT round(-sum(p * w * log2(w)), 9) AS h FROM t3 JOIN u3 ON node = i"))
def entropy_rate(spark, d):
    return rounded(mk.entropy_rate(mx.stochastic(fx.network(spark, d), "i"), fx.shares(spark, d)), "h")


@query(sql("t3 u3", "SELECT round(h, 9) AS h, round(r, 9) AS r, round(h - r, 9) AS mi FROM (SELECT -sum(p * log2(p)) AS h FROM u3), (SELECT -sum(p * w * log2(w)) AS r FROM t3 JOIN u3 ON node = i)"))
def markov_mutual_information(spark, d):
    return rounded(mk.mutual_information(mx.stochastic(fx.network(spark, d), "i"), fx.shares(spark, d)), "h", "r", "mi")


@query(sql("f3", "SELECT min(w) AS min_w, max(w) AS max_w, (SELECT i FROM f3 ORDER BY w DESC, j, i LIMIT 1) AS arg_i, (SELECT j FROM f3 ORDER BY w DESC, j, i LIMIT 1) AS arg_j, count(*) AS nnz, sum(w) AS sum_w FROM f3"))
def matrix_minmax_argmax(spark, d):
    return mx.extremes(fx.network(spark, d))


@query(sql("f3", "SELECT i, j, round(greatest(0e0, least(1e0, w / (SELECT avg(w) FROM f3))), 9) AS w FROM f3"))
def clamp_unit(spark, d):
    n = fx.network(spark, d)
    return rounded(mx.clamped(n.crossJoin(F.broadcast(n.agg(F.avg("w").alias("m")))).select("i", "j", (F.col("w") / F.col("m")).alias("w"))), "w")


@query(sql("f3", "SELECT count(*) AS n, sum((w > 100)::INT)::BIGINT AS above, sum((w < 100)::INT)::BIGINT AS below, coalesce(bool_or(w > 100), false) AS any_b FROM f3"))
def cwise_gt_any(spark, d):
    n = fx.network(spark, d)
    above, below = mx.compared(n, 100.0), mx.compared(n, 100.0, greater=False)
    count = lambda f, name: f.agg(F.count_if("b").alias(name))
    return above.agg(F.count("*").alias("n")).crossJoin(count(above, "above")).crossJoin(count(below, "below")).crossJoin(mx.any_true(above))


# Lumping and flows


@query(sql("t3 u3", "SELECT i, j, round(p * w, 12) AS w FROM t3 JOIN u3 ON node = i"))
def node_flow(spark, d):
    return rounded(mk.node_flow(mx.stochastic(fx.network(spark, d), "i"), fx.shares(spark, d)), "w", digits=12)


ENDS = "e AS (SELECT f3.*, a.com AS ci, b.com AS cj FROM f3 JOIN com a ON a.node = i JOIN com b ON b.node = j)"
TENDS = "e AS (SELECT t3.*, p, a.com AS ci, b.com AS cj FROM t3 JOIN u3 ON u3.node = i JOIN com a ON a.node = i JOIN com b ON b.node = j)"


def chain(spark, d):
    return mx.stochastic(fx.network(spark, d), "i")


@query(sql("f3 com", "SELECT ci AS i, cj AS j, sum(w) AS w FROM e GROUP BY 1, 2", ENDS))
def com_flow(spark, d):
    return mk.community_flow(fx.network(spark, d), fx.members(spark, d))


@query(sql("t3 u3 com", "SELECT ci AS i, cj AS j, round(sum(p * w), 9) AS w FROM e GROUP BY 1, 2", TENDS))
def com_flow_from_rank(spark, d):
    return rounded(mk.community_flow(mk.node_flow(chain(spark, d), fx.shares(spark, d)), fx.members(spark, d)), "w")


@query(sql("f3 com", "SELECT i AS node, cj AS com, sum(w) AS w FROM e GROUP BY 1, 2", ENDS))
def node_to_com_flow_to(spark, d):
    return mk.node_community_flow(fx.network(spark, d), fx.members(spark, d), "to")


@query(sql("f3 com", "SELECT j AS node, ci AS com, sum(w) AS w FROM e GROUP BY 1, 2", ENDS))
def node_to_com_flow_from(spark, d):
    return mk.node_community_flow(fx.network(spark, d), fx.members(spark, d), "from")


@query(sql("t3 u3 com", "SELECT i AS node, cj AS com, round(sum(w), 9) AS w FROM e GROUP BY 1, 2", TENDS))
def node_to_com_trans_to(spark, d):
    return rounded(mk.node_community_transition(chain(spark, d), fx.members(spark, d), fx.shares(spark, d), "to"), "w")


@query(sql("t3 u3 com", "SELECT j AS node, ci AS com, round(sum(p * w) / (SELECT sum(p) FROM u3 JOIN com m USING (node) WHERE m.com = ci), 9) AS w FROM e GROUP BY 1, 2", TENDS))
def node_to_com_trans_from(spark, d):
    return rounded(mk.node_community_transition(chain(spark, d), fx.members(spark, d), fx.shares(spark, d), "from"), "w")


@query(sql("t3 u3 com", "SELECT ci AS i, cj AS j, round(sum(w) / sum(sum(w)) OVER (PARTITION BY ci), 9) AS w FROM e GROUP BY 1, 2", TENDS))
def com_trans_unweighted(spark, d):
    return rounded(mk.community_transition(chain(spark, d), fx.members(spark, d)), "w")


@query(sql("t3 u3 com", "SELECT ci AS i, cj AS j, round(sum(p * w) / (SELECT sum(p) FROM u3 JOIN com m USING (node) WHERE m.com = ci), 9) AS w FROM e GROUP BY 1, 2", TENDS))
def lumped_transition(spark, d):
    return rounded(mk.lumped(chain(spark, d), fx.members(spark, d), fx.shares(spark, d)), "w")


@query(sql("t3 u3 com", "SELECT x.j AS i, y.j AS j, round(sum(p * x.w * t3.w * y.w) / max(q), 9) AS w FROM t3 JOIN u3 ON u3.node = t3.i JOIN m x ON x.i = t3.i JOIN m y ON y.i = t3.j JOIN mu ON mu.node = x.j GROUP BY 1, 2", "m AS (SELECT node AS i, com AS j, 0.75e0 AS w FROM com UNION ALL SELECT node, com % 5 + 1, 0.25e0 FROM com), mu AS (SELECT m.j AS node, sum(p * w) AS q FROM m JOIN u3 ON u3.node = m.i GROUP BY 1)"))
def fuzzy_reduction(spark, d):
    m = fx.members(spark, d)
    fuzzy = m.select(F.col("node").alias("i"), F.col("com").alias("j"), F.lit(0.75).alias("w")).unionByName(m.select(F.col("node").alias("i"), (F.col("com") % 5 + 1).alias("j"), F.lit(0.25).alias("w")))
    return rounded(mk.fuzzy_lumped(chain(spark, d), fuzzy, fx.shares(spark, d)), "w")


@query(sql("t3 u3", "SELECT i, j, round(sum(w) / 2, 9) AS w FROM (SELECT i, j, w FROM t3 UNION ALL SELECT t3.j, t3.i, a.p * t3.w / b.p FROM t3 JOIN u3 a ON a.node = t3.i JOIN u3 b ON b.node = t3.j) GROUP BY 1, 2"))
def additive_reversible(spark, d):
    return rounded(mk.additive_reversible(chain(spark, d), fx.shares(spark, d)), "w")


@query(sql("t3 u3", "SELECT t3.j AS i, t3.i AS j, round(sqrt(b.p) * t3.w / sqrt(a.p), 9) AS w FROM t3 JOIN u3 a ON a.node = t3.i JOIN u3 b ON b.node = t3.j"))
def sym_markov(spark, d):
    return rounded(mk.symmetrised(chain(spark, d), fx.shares(spark, d)), "w")


@query(sql("u3 com", "SELECT com, round(sum(p), 9) AS p FROM com JOIN u3 USING (node) GROUP BY 1"))
def community_rank(spark, d):
    return rounded(mk.community_rank(fx.members(spark, d), fx.shares(spark, d)), "p")


@query(sql("u3 com", "SELECT node, coalesce(label, 0)::BIGINT AS com FROM com LEFT JOIN k USING (com)", "k AS (SELECT com, row_number() OVER (ORDER BY com) AS label FROM (SELECT com, sum(p) AS p FROM com JOIN u3 USING (node) GROUP BY 1) WHERE p >= 0.19e0 AND com > 0)"))
def community_filter(spark, d):
    return mk.community_filter(fx.members(spark, d), fx.shares(spark, d), 0.19)


@query(sql("f2", "SELECT t, com, round(avg(value), 9) AS value FROM f2 JOIN (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS node, unnest([1, 1, 2, 2, 0])::BIGINT AS com) USING (node) WHERE com > 0 AND abs(value) <= 1e6 GROUP BY 1, 2"))
def community_series(spark, d):
    return rounded(ts.community_series(fx.field(spark, d), type_members(spark)), "value")


def type_members(spark):
    return spark.range(5).select(F.col("id").alias("node"), F.element_at(F.array(*[F.lit(k).cast("long") for k in (1, 1, 2, 2, 0)]), (F.col("id") + 1).cast("int")).alias("com"))


# Matrix edits and products


@query(sql("f3", "SELECT i, j, CASE WHEN j = 3 THEN w * 2 ELSE w END AS w FROM f3"))
def scale_column(spark, d):
    return mx.scaled_line(fx.network(spark, d), "j", 3, 2.0)


@query(sql("f3", "SELECT i, j, CASE WHEN i = 3 THEN w * 2 ELSE w END AS w FROM f3"))
def scale_row(spark, d):
    return mx.scaled_line(fx.network(spark, d), "i", 3, 2.0)


@query(sql("f3", "SELECT i, j, sum(w) AS w FROM (SELECT * FROM f3 UNION ALL SELECT i, 0::BIGINT, w FROM f3 WHERE j = 1) GROUP BY 1, 2"))
def col_merge(spark, d):
    return mx.added_line(fx.network(spark, d), "j", 1, 0)


@query(sql("f3", "SELECT i, j, sum(w) AS w FROM (SELECT * FROM f3 UNION ALL SELECT 0::BIGINT, j, w FROM f3 WHERE i = 1) GROUP BY 1, 2"))
def row_merge(spark, d):
    return mx.added_line(fx.network(spark, d), "i", 1, 0)


@query(sql("f3 u3", "SELECT i, j, w FROM f3 WHERE i <> 2 UNION ALL SELECT 2::BIGINT, node, round(p, 9) FROM u3"))
def set_row(spark, d):
    return mx.replaced_line(fx.network(spark, d), "i", 2, rounded(fx.shares(spark, d), "p"))


@query(sql("f3 u3", "SELECT i, j, w FROM f3 WHERE j <> 2 UNION ALL SELECT node, 2::BIGINT, round(p, 9) FROM u3"))
def set_col(spark, d):
    return mx.replaced_line(fx.network(spark, d), "j", 2, rounded(fx.shares(spark, d), "p"))


@query(sql("t3", "SELECT a.i, b.j, round(sum(a.w * b.w), 9) AS w FROM t3 a JOIN t3 b ON a.j = b.i GROUP BY 1, 2"))
def matrix_square(spark, d):
    t = chain(spark, d)
    return rounded(mx.product(t, t), "w")


@query(sql("t3 u3", "SELECT j AS node, round(sum(p * w), 9) AS p FROM t3 JOIN u3 ON node = i GROUP BY 1"))
def vector_step(spark, d):
    return rounded(mx.vector_product(fx.shares(spark, d), chain(spark, d)), "p")


@query(sql("f3", "SELECT i, j, w FROM f3 WHERE i <= j"))
def upper_triangle(spark, d):
    return mx.upper_triangle(fx.network(spark, d))


@query(sql("f3", "SELECT least(i, j) AS i, greatest(i, j) AS j, sum(w) AS w FROM f3 GROUP BY 1, 2 UNION ALL SELECT greatest(i, j) AS i, least(i, j) AS j, sum(w) AS w FROM f3 WHERE i <> j GROUP BY 1, 2"))
def symmetric_storage(spark, d):
    both = fx.network(spark, d).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w").groupBy("i", "j").agg(F.sum("w").alias("w"))
    return mx.from_upper_triangle(mx.upper_triangle(both))


@query("SELECT n_nationkey::BIGINT AS node, 1e0 AS p FROM nation")
def constant_vector(spark, d):
    return mx.constant_vector(fx.nodes(spark, d), 1)


@query("WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer) SELECT k::BIGINT AS node, round(lo + k * ((hi - lo) / (n - 1)), 6) AS p FROM (SELECT unnest(generate_series(0, (SELECT n - 1 FROM r))) AS k), r")
def linspaced_vector(spark, d):
    r = fx.read(spark, d, "customer").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("*").alias("n")).first()
    return rounded(mx.linspaced_vector(r.n, r.lo, r.hi, spark), "p", digits=6)


# Time series


@query(sql("f6", "SELECT t, node, round(value - avg(value) OVER (PARTITION BY node, t % 12), 9) AS value FROM f6"))
def anomaly(spark, d):
    return rounded(ts.anomaly(fx.monthly(spark, d), 12), "value")


@query(sql("f2", "SELECT t, node, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 9) AS value FROM f2 WINDOW w AS (PARTITION BY node)"))
def standardize(spark, d):
    return rounded(ts.standardised(fx.field(spark, d)), "value")


LAG = "l AS (SELECT node, value, lead(value) OVER (PARTITION BY node ORDER BY t) AS later FROM {0})"
CORR = "covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1}))"


@query(sql("f2", f"SELECT node, round({CORR.format('value', 'later')}, 9) AS a FROM l WHERE later IS NOT NULL GROUP BY 1", LAG.format("f2")))
def lag_autocorr(spark, d):
    return rounded(ts.lag_autocorrelation(fx.field(spark, d)), "a")


@query(sql("f2n", f"SELECT node, round({CORR.format('value', 'later')}, 9) AS a FROM l WHERE later IS NOT NULL AND value IS NOT NULL GROUP BY 1", LAG.format("f2n")))
def lag_autocorr_masked(spark, d):
    return rounded(ts.lag_autocorrelation(fx.field(spark, d, None)), "a")


@query(sql("f2", f"SELECT node, CASE WHEN a > 0 AND a < 1 THEN round(-1e0 / ln(a), 6) END AS tau FROM (SELECT node, {CORR.format('value', 'later')} AS a FROM l WHERE later IS NOT NULL GROUP BY 1)", LAG.format("f2")))
def persist_time(spark, d):
    return rounded(ts.persistence_times(fx.field(spark, d)), "tau", digits=6)


@query(sql("f2", f"SELECT lag::BIGINT AS lag, a.node AS i, b.node AS j, round({CORR.format('a.value', 'b.value')}, 9) AS r FROM (SELECT *, t + lag AS u FROM f2, (SELECT unnest([0, 1, 6]) AS lag)) a JOIN f2 b ON b.t = a.u GROUP BY 1, 2, 3"))
def cross_corr_lags(spark, d):
    return rounded(ts.cross_correlation(fx.field(spark, d), fx.field(spark, d), [0, 1, 6]).withColumn("lag", F.col("lag").cast("long")), "r")


CCF = "a AS (SELECT t, {0} AS x FROM f2 WHERE node = 0), b AS (SELECT t AS u, {0} AS y FROM f2 WHERE node = 4), z AS (SELECT *, t + lag AS u FROM a, (SELECT unnest(generate_series(-12, 12)) AS lag))"


def ends(spark, d):
    f = fx.field(spark, d)
    return f.filter("node = 0"), f.filter("node = 4")


@query(sql("f2", "SELECT lag::BIGINT AS lag, round(avg(x * y), 9) AS c FROM z JOIN b USING (u) GROUP BY 1", CCF.format("(value - avg(value) OVER ()) / stddev_pop(value) OVER ()")))
def ccf(spark, d):
    return rounded(ts.ccf(*ends(spark, d), 12).withColumn("lag", F.col("lag").cast("long")), "c")


@query(sql("f2", "SELECT lag::BIGINT AS lag, round(avg(x * y), 6) AS c FROM z JOIN b USING (u) GROUP BY 1", CCF.format("value - avg(value) OVER ()")))
def ccovf(spark, d):
    return rounded(ts.ccovf(*ends(spark, d), 12).withColumn("lag", F.col("lag").cast("long")), "c", digits=6)


@query(sql("f2", "SELECT node, t, x0, x1, x2 FROM (SELECT node, t, value AS x0, lag(value, 1) OVER w AS x1, lag(value, 5) OVER w AS x2, row_number() OVER w AS r FROM f2 WINDOW w AS (PARTITION BY node ORDER BY t)) WHERE r > 5"))
def delay_embedding(spark, d):
    return ts.delay_embedding(fx.field(spark, d), [1, 5])


@query(sql("f6", "SELECT t, node, value FROM f6 WHERE t < (SELECT (max(t) + 1) // 12 * 12 FROM f6) AND t % 12 IN (0, 1, 11)"))
def select_phases(spark, d):
    return ts.select_phases(fx.monthly(spark, d), [0, 1, 11], 12)


@query(sql("f2", f"SELECT a.node AS i, b.node AS j, round({CORR.format('a.value', 'b.value')}, 9) AS r FROM f2 a JOIN f2 b USING (t) WHERE a.node < b.node GROUP BY 1, 2"))
def pearson_pairs(spark, d):
    return rounded(ts.pearson_pairs(fx.field(spark, d)), "r")


@query(sql("f2n", f"SELECT a.node AS i, b.node AS j, round({CORR.format('a.value', 'b.value')}, 9) AS r FROM f2n a JOIN f2n b USING (t) WHERE a.node < b.node AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2"))
def pearson_pairs_masked(spark, d):
    return rounded(ts.pearson_pairs(fx.field(spark, d, None)), "r")


@query(sql("f2", "SELECT a.node AS i, b.node AS j, round(sum(a.value * b.value) / (count(*) - 1), 6) AS c FROM f2 a JOIN f2 b USING (t) WHERE a.node < b.node GROUP BY 1, 2"))
def cov_pairs_uncentred(spark, d):
    return rounded(ts.uncentred_covariance(fx.field(spark, d)), "c", digits=6)


@query(sql("f2", "SELECT i, j, round(hi.h + hj.h - hij.h, 9) AS mi FROM (SELECT i, j, -sum(n / nn * ln(n / nn)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY i, j) AS nn FROM jn) GROUP BY 1, 2) hij JOIN h hi ON hi.node = i JOIN h hj ON hj.node = j", "b AS (SELECT t, node, least(9, floor((value - (SELECT min(value) FROM f2)) / (SELECT max(value) - min(value) FROM f2) * 10))::BIGINT AS bin FROM f2), h AS (SELECT node, -sum(n / nn * ln(n / nn)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY node) AS nn FROM (SELECT node, bin, count(*) AS n FROM b GROUP BY 1, 2)) GROUP BY 1), jn AS (SELECT x.node AS i, y.node AS j, x.bin, y.bin AS bj, count(*) AS n FROM b x JOIN b y USING (t) WHERE x.node <= y.node GROUP BY 1, 2, 3, 4)"))
def mutual_info_hist(spark, d):
    return rounded(ts.mutual_information(fx.field(spark, d), 10), "mi")


@query(sql("f2", "SELECT p, round(x + (p - c) / (c1 - c) * (x1 - x), 9) AS x FROM (SELECT unnest([0.9e0, 0.95e0, 0.99e0]) AS p) JOIN (SELECT *, lead(c) OVER (ORDER BY bin) AS c1, lead(x) OVER (ORDER BY bin) AS x1 FROM s) ON p >= c AND p < c1", "r AS (SELECT min(value) - (max(value) - min(value)) / 38e0 AS lo, (max(value) - min(value)) * 20e0 / 19e0 / 20e0 AS wd, count(*) AS nn FROM f2), k AS (SELECT least(19, floor((value - lo) / wd))::BIGINT AS bin, count(*) AS n FROM f2, r GROUP BY 1), s AS (SELECT g AS bin, sum(coalesce(n, 0)) OVER (ORDER BY g) / nn AS c, lo + (g + 0.5e0) * wd AS x FROM (SELECT unnest(generate_series(0, 19)) AS g) LEFT JOIN k ON bin = g, r)"))
def iecdf(spark, d):
    return rounded(ts.inverse_ecdf(fx.field(spark, d), [0.9, 0.95, 0.99], 20), "x")


@query(sql("f2", "SELECT node, round(0.5e0 * log2(2 * pi() * exp(1e0) * var_pop(value)), 9) AS h FROM f2 GROUP BY 1"))
def log_det_entropy(spark, d):
    return fx.field(spark, d).groupBy("node").agg(F.var_pop("value").alias("v")).select("node", r9(gaussian_entropy("v"), "h"))


@query(sql("f2", "SELECT node, min(t) AS t FROM f2 WHERE value = 0 GROUP BY 1"))
def find_first(spark, d):
    return ts.find_first(fx.field(spark, d), 0.0)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def unique_rows(spark, d):
    return ts.unique_rows(fx.read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey AS node, o_totalprice AS value FROM orders WHERE abs(o_totalprice - 1000) > 0.5")
def missing_to_null(spark, d):
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("value"))
    return ts.missing_to_null(o, 1000.0, 0.5).filter("value is not null")


@query(sql("f2", f"SELECT a.com AS i, b.com AS j, round({CORR.format('a.v', 'b.v')}, 9) AS r FROM c a JOIN c b USING (t) WHERE a.com < b.com GROUP BY 1, 2", "c AS (SELECT t, com, avg(value) AS v FROM f2 JOIN (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS node, unnest([1, 1, 2, 2, 0])::BIGINT AS com) USING (node) WHERE com > 0 AND abs(value) <= 1e6 GROUP BY 1, 2)"))
def com_corr(spark, d):
    return rounded(ts.community_correlation(fx.field(spark, d), type_members(spark)), "r")


# Networks


EMB = "v AS (SELECT vec_id AS node, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), z AS (SELECT node, list_transform(e, lambda x: x - m) AS c FROM v), q AS (SELECT node, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS u FROM z), sim AS (SELECT a.node AS i, b.node AS j, list_dot_product(a.u, b.u) AS w FROM q a JOIN q b ON a.node < b.node)"


def vectors(spark, d):
    return fx.read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))


@query(f"WITH {EMB} SELECT i, j FROM sim WHERE round(w, 9) >= 0.3e0 UNION ALL SELECT j, i FROM sim WHERE round(w, 9) >= 0.3e0")
def adjacency_threshold(spark, d):
    return nw.similar_links(vectors(spark, d), 0.3, digits=9)


@query(f"WITH {EMB}, e AS (SELECT i, j, round(w, 9) AS w FROM sim WHERE abs(w) > 0.35e0) SELECT * FROM e UNION ALL SELECT j, i, w FROM e")
def corr_network_edges(spark, d):
    return nw.correlation_edges(vectors(spark, d), 0.35, digits=9)


@query(SQL["corr_network_edges"])
def corr_network_pruned(spark, d):
    return nw.correlation_edges(vectors(spark, d), 0.35, block=64, pivots=16, digits=9)


@query(f"WITH RECURSIVE {EMB}, e AS MATERIALIZED (SELECT i, j, round(w, 9) AS w FROM sim WHERE abs(w) > 0.35e0), ee AS MATERIALIZED (SELECT i, j FROM e UNION SELECT j, i FROM e), c AS (SELECT i AS node, i AS label FROM ee UNION SELECT ee.j, c.label FROM c JOIN ee ON ee.i = c.node), l AS (SELECT node, min(label) AS label FROM c GROUP BY 1), g AS (SELECT label FROM l GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1), k AS (SELECT e.* FROM e JOIN l ON node = i JOIN g USING (label)) SELECT * FROM k UNION ALL SELECT j, i, w FROM k")
def corr_network_giant(spark, d):
    return nw.correlation_edges(vectors(spark, d), 0.35, giant=True, digits=9)


@query(f"WITH {EMB}, s AS (SELECT round(abs(w), 9) AS w FROM sim), r AS (SELECT max(w) AS top, count(*) AS nn FROM s), k AS (SELECT least(49, floor(w * 50 / top))::BIGINT AS bin, count(*) AS n FROM s, r GROUP BY 1) SELECT g::BIGINT AS bin, round(g * top / 50, 6) AS threshold, round(sum(coalesce(n, 0)) OVER (ORDER BY g DESC) / nn, 9) AS density FROM (SELECT unnest(generate_series(0, 50)) AS g) LEFT JOIN k ON bin = g, r")
def edge_density_function(spark, d):
    return rounded(rounded(nw.edge_density_of(vectors(spark, d), 50, digits=9), "threshold", digits=6), "density")


@query(f"WITH {EMB}, n AS (SELECT count(*) AS n FROM embeddings), a AS (SELECT round(w, 9) AS w FROM sim UNION ALL SELECT round(w, 9) FROM sim UNION ALL SELECT 1e0 FROM embeddings) SELECT w AS threshold FROM (SELECT w, row_number() OVER (ORDER BY w) - 1 AS k FROM a), n WHERE k = floor((1e0 - 0.1e0) * (n * n - n))::BIGINT")
def threshold_from_density(spark, d):
    return nw.threshold_of_density_of(vectors(spark, d), 0.1, digits=9)


@query(sql("f3t com", "SELECT node, count(i) AS k FROM com LEFT JOIN f3t ON i = node GROUP BY 1"))
def degree(spark, d):
    return nw.degree(fx.sparse_network(spark, d), nodes=fx.nodes(spark, d))


@query(sql("f3t", "SELECT i AS node, sum(w) AS s FROM f3t GROUP BY 1"))
def strength_out(spark, d):
    return nw.strength(fx.sparse_network(spark, d))


@query(sql("f3t", "SELECT j AS node, sum(w) AS s FROM f3t GROUP BY 1"))
def strength_in(spark, d):
    return nw.strength(fx.sparse_network(spark, d), inward=True)


@query(sql("f3t", "SELECT j AS node, round(sum(w) / (SELECT sum(w) FROM f3t), 9) AS s FROM f3t GROUP BY 1"))
def weighted_degree_norm(spark, d):
    return rounded(nw.strength(fx.sparse_network(spark, d), inward=True, norm=True), "s")


@query(sql("f3t com", "SELECT node, round(coalesce(h, 0e0), 9) AS h FROM com LEFT JOIN (SELECT i AS node, -sum(p * ln(p)) AS h FROM (SELECT i, w / sum(w) OVER (PARTITION BY i) AS p FROM f3t) GROUP BY 1) USING (node)"))
def local_entropy_nats(spark, d):
    return rounded(mk.local_entropy(fx.sparse_network(spark, d), nodes=fx.nodes(spark, d)), "h")


@query(sql("f3", "SELECT node, sum(a) AS out_weight, sum(b) AS in_weight FROM (SELECT i AS node, w AS a, 0e0 AS b FROM f3 WHERE i < 12 AND j >= 12 UNION ALL SELECT j, 0e0, w FROM f3 WHERE i >= 12 AND j < 12) GROUP BY 1"))
def cross_degree(spark, d):
    return nw.cross_degree(fx.network(spark, d), 25)


PAIRS = "pr AS (SELECT a.node AS i, b.node AS j, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM f5 a JOIN f5 b ON a.node < b.node)"
ARC = "6371009e0 * acos(least(1e0, greatest(-1e0, sin(radians(lat1)) * sin(radians(lat2)) + cos(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon1) - radians(lon2)))))"
PLANAR = "sqrt(((((lon1 - lon2) % 180) + 180) % 180) ** 2 + (lat1 - lat2) ** 2)"


@query(sql("f5", f"SELECT i, j, round({ARC}, 3) AS d FROM pr", PAIRS))
def geo_dist_arc(spark, d):
    return rounded(nw.distances(fx.places(spark, d)), "d", digits=3)


@query(sql("f5", f"SELECT i, j, round({PLANAR}, 9) AS d FROM pr", PAIRS))
def geo_dist_planar(spark, d):
    return rounded(nw.distances(fx.places(spark, d), arc=False), "d")


@query(sql("f5", "SELECT i, j, round(atan2(lat2 - lat1, lon2 - lon1), 9) AS angle FROM pr UNION ALL SELECT j, i, round(atan2(lat2 - lat1, lon2 - lon1), 9) FROM pr", PAIRS))
def zonal_angle(spark, d):
    return rounded(nw.zonal_angles(fx.places(spark, d)), "angle")


@query(sql("f3 f5", "SELECT f3.j AS node, round(sum(abs(w * cos(angle))), 6) AS x, round(sum(abs(w * sin(angle))), 6) AS y FROM f3 JOIN (SELECT i, j, atan2(lat2 - lat1, lon2 - lon1) AS angle FROM pr UNION ALL SELECT j, i, atan2(lat2 - lat1, lon2 - lon1) FROM pr) USING (i, j) GROUP BY 1", PAIRS))
def degree_proj_xy(spark, d):
    return rounded(nw.projected_degree(fx.network(spark, d), nw.zonal_angles(fx.places(spark, d))), "x", "y", digits=6)


@query(sql("f3t f5", "SELECT node, round(coalesce(k, 0) * cos(radians(lat)) / (SELECT sum(cos(radians(lat))) FROM f5), 9) AS c FROM f5 LEFT JOIN (SELECT i AS node, count(*) AS k FROM f3t GROUP BY 1) USING (node)"))
def area_weighted_connectivity(spark, d):
    return rounded(nw.area_weighted_connectivity(fx.sparse_network(spark, d), fx.places(spark, d)), "c")


@query(sql("f5 f3", f"SELECT i, j, round(1000e0 * abs(fj - fi) / ({PLANAR})) AS w FROM pr JOIN v a ON a.node = i JOIN (SELECT node, fi AS fj FROM v) b ON b.node = j", PAIRS + ", v AS (SELECT i AS node, sum(w) / 1000e0 AS fi FROM f3 GROUP BY 1)"))
def gradient_similarity(spark, d):
    value = mx.sums(fx.network(spark, d), "i").select("node", (F.col("s") / 1000).alias("value"))
    return nw.gradient_similarity(value, nw.distances(fx.places(spark, d), arc=False), 1000.0)


@query(sql("f3 f5", f"SELECT pp.i, pp.j FROM (SELECT i, j, {PLANAR} AS d FROM pr UNION ALL SELECT j, i, {PLANAR} FROM pr) pp JOIN v ON v.node = pp.i WHERE d <= sqrt(3000e0 / pi()) * (u * u + vv * vv) ** 0.25e0", PAIRS + ", v AS (SELECT node, sum(a) AS u, sum(b) AS vv FROM (SELECT i AS node, w / 1000e0 AS a, 0e0 AS b FROM f3 UNION ALL SELECT j, 0e0, w / 1000e0 FROM f3) GROUP BY 1)"))
def flow_adjacency(spark, d):
    n = fx.network(spark, d)
    both = n.select(F.col("i").alias("node"), (F.col("w") / 1000).alias("u"), F.lit(0.0).alias("v")).unionByName(n.select(F.col("j").alias("node"), F.lit(0.0).alias("u"), (F.col("w") / 1000).alias("v")))
    return nw.flow_adjacency(both.groupBy("node").agg(F.sum("u").alias("u"), F.sum("v").alias("v")), nw.distances(fx.places(spark, d), arc=False), 3000.0)


@query(sql("f3", "SELECT round((coalesce(sum(w) FILTER (i = j), 0e0) - 1) / 25, 9) AS q FROM f3"))
def self_loop_score(spark, d):
    return rounded(nw.self_loop_score(fx.network(spark, d), 25), "q")


@query(sql("f3 com", "SELECT round(sum(own / ww - o * k / (ww * ww)), 9) AS q FROM (SELECT com, sum(o) AS o, sum(k) AS k, sum(own) AS own FROM (SELECT ci AS com, w AS o, 0e0 AS k, CASE WHEN ci = cj THEN w ELSE 0e0 END AS own FROM e UNION ALL SELECT cj, 0e0, w, 0e0 FROM e) GROUP BY 1), (SELECT sum(w) AS ww FROM f3)", ENDS))
def modularity(spark, d):
    return rounded(nw.modularity(fx.network(spark, d), fx.members(spark, d)), "q")


def unrolled_rank(steps: int, damping: float | None) -> str:
    value = "coalesce(m, 0e0)" if damping is None else f"{damping}e0 * coalesce(m, 0e0) + (1e0 - {damping}e0) * p0.p"
    ctes = ["p0 AS (SELECT node, 1e0 / count(*) OVER () AS p FROM com)"]
    ctes += [f"p{k} AS (SELECT p0.node, {value} AS p FROM p0 LEFT JOIN (SELECT j AS node, sum(p{k - 1}.p * t3.w) AS m FROM t3 JOIN p{k - 1} ON p{k - 1}.node = i GROUP BY 1) USING (node))" for k in range(1, steps + 1)]
    return sql("t3 com", f"SELECT node, round(p, 9) AS p FROM p{steps}", ", ".join(ctes))


@query(unrolled_rank(8, None))
def pagerank_k(spark, d):
    return rounded(mk.pagerank(fx.network(spark, d), fx.nodes(spark, d), max_iter=8), "p")


@query(unrolled_rank(8, 0.85))
def pagerank_damped_k(spark, d):
    return rounded(mk.pagerank(fx.network(spark, d), fx.nodes(spark, d), damping=0.85, max_iter=8), "p")


@query(sql("f3t com", "SELECT node, round(25e0 / (sum(d) + (25 - count(*)) * 25), 9) AS c FROM (SELECT i AS node, j, min(d) AS d FROM p8 GROUP BY 1, 2) GROUP BY 1", "e AS (SELECT i, j, min(w) AS w FROM f3t WHERE i <> j GROUP BY 1, 2), p0 AS (SELECT node AS i, node AS j, 0e0 AS d FROM com UNION ALL SELECT i, j, w FROM e), " + ", ".join(f"p{k} AS MATERIALIZED (SELECT i, j, min(d) AS d FROM (SELECT * FROM p{k - 1} UNION ALL SELECT a.i, b.j, a.d + b.d FROM p{k - 1} a JOIN p{k - 1} b ON a.j = b.i) GROUP BY 1, 2)" for k in range(1, 9))))
def closeness(spark, d):
    return rounded(nw.closeness(fx.sparse_network(spark, d), fx.nodes(spark, d)), "c")


@query(None)
def community_peel(spark, d):
    return nw.community_peel_filter(fx.sparse_network(spark, d), fx.members(spark, d), 0.5, 2)


# Code length


@query(sql("t3 u3 com", "SELECT round(hu - hq + hqm, 9) AS l, round(hu, 9) AS hu, round(hq, 9) AS hq, round(hqm, 9) AS hqm FROM (SELECT -sum(p * log2(p)) AS hu FROM u3), (SELECT -sum(q * log2(q)) AS hq FROM qm), (SELECT -sum(q * tm.w * log2(tm.w)) AS hqm FROM tm JOIN qm ON com = ci)", TENDS + ", qm AS (SELECT com, sum(p) AS q FROM com JOIN u3 USING (node) GROUP BY 1), tm AS (SELECT ci, cj, sum(w) / sum(sum(w)) OVER (PARTITION BY ci) AS w FROM e GROUP BY 1, 2)"))
def codelength_two_level(spark, d):
    return rounded(two_level_codelength(chain(spark, d), fx.members(spark, d), fx.shares(spark, d)), "l", "hu", "hq", "hqm")
