"""URL filter: rules first, then gradient-boosted trees on lexical features, all in DataFrame functions and JVM ML.

A rule ``host/path`` fits its host and all its subdomains where the URL's path starts with the rule's; the longest
rule wins (ties: the first in order). URLs that a rule decides are the labelled ones; on a bounded sample of them
(``train_rows`` of each verdict, of least hash) boosted trees are trained, and they judge the URLs that no rule fits.
Suffix statistics (how often a host's last two labels, and its last one, were blocked) are counted over all labelled
URLs; a labelled URL itself is left out of its own, so that they do not give its verdict away. The trees learn from each
URL of the sample twice, with its statistics and as one whose suffixes nobody has seen, so that hosts under unknown suffixes
are judged by the lexical features.

Defined cases: null ids stay null; null or without ``://`` means empty host and path; such URLs are judged by the trees like others; when
the labelled URLs show one verdict only, or none, the trees' verdict is that one, or ``allow``; repeated rows are
judged each; very long URLs are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, materialise, table

#: Verdict by host and path; fixed values of the query.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "host_length", "hyphens", "suffix1", "suffix2", "seen1", "seen2")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (lower-cased A-Z) and path."""
    at = F.coalesce(F.locate("://", F.col(url_col)), F.lit(0))
    rest = F.when(at > 0, F.col(url_col).substr(at + 3, F.length(url_col))).otherwise("")
    split = pages.withColumn("rest", rest)
    return split.withColumn("host", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER)).withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)).drop("rest")


def rule_of(rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path, else null."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def lexical(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Length, depth, digit ratio, character entropy, parameter count and shape of the host."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    labels = F.split("host", r"\.")
    return (
        pages.withColumn("length", F.length(url).cast("double"))
        .withColumn("depth", (F.size(F.split("path", "/")) - 1).cast("double"))
        .withColumn("digits", F.length(F.regexp_replace(url, "[^0-9]", "")) / size)
        .withColumn("entropy", F.round(entropy, 9))
        .withColumn("params", F.length(F.regexp_replace(url, "[^=&?#]", "")).cast("double"))
        .withColumn("labels", F.size(labels).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("hyphens", F.length(F.regexp_replace("host", "[^-]", "")).cast("double"))
        .withColumn("last1", F.element_at(labels, -1))
        .withColumn("last2", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))
    )


def suffix_statistics(labelled: DataFrame) -> list[DataFrame]:
    """For the last label and the last two: blocked URLs and all, of the labelled ones."""
    return [labelled.groupBy(f"last{k}").agg(F.sum("blocked").alias("b"), F.count("*").alias("n")) for k in ("1", "2")]


def with_suffixes(rows: DataFrame, statistics: list[DataFrame]) -> DataFrame:
    """``blocked`` (null where no rule decides) leaves a row out of its own statistics."""
    own = F.col("blocked").isNotNull().cast("int")
    for k, s in zip(("1", "2"), statistics, strict=True):
        rows = rows.join(s, f"last{k}", "left")
        n, b = F.coalesce("n", F.lit(0)) - own, F.coalesce("b", F.lit(0.0)) - F.coalesce("blocked", F.lit(0.0))
        rows = rows.withColumn(f"suffix{k}", (b + 1) / (n + 2)).withColumn(f"seen{k}", F.log1p(n)).drop("n", "b")
    return rows


def unseen(rows: DataFrame) -> DataFrame:
    """``rows`` as if their suffixes were in no labelled URL."""
    return rows.withColumns({"suffix1": F.lit(0.5), "suffix2": F.lit(0.5), "seen1": F.lit(0.0), "seen2": F.lit(0.0)})


def features(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict and blocked (null where no rule decides), and the lexical features."""
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    verdicts = F.create_map(*[F.lit(x) for kv in (rules or {"": ""}).items() for x in kv])
    rows = lexical(parts(plain).withColumn("rule", rule_of(rules))).withColumn("verdict", verdicts[F.coalesce("rule", F.lit(""))])
    return materialise(rows.withColumn("blocked", F.when(F.col("verdict") == "block", 1.0).when(F.col("verdict").isNotNull(), 0.0)), "urls")


def trees_of(labelled: DataFrame, statistics: list[DataFrame], train_rows: int = 8000, trees: int = 8, depth: int = 4) -> tuple[str, PipelineModel | None]:
    """(verdict where there are no trees, trees): the trees are trained if both verdicts occur in ``labelled``."""
    seen = {r.blocked: r.n for r in labelled.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return "block" if 1.0 in seen else "allow", None
    keyed = labelled.withColumn("key", F.struct("url", "page_id"))
    known = with_suffixes(bounded_sample(keyed, "blocked", "key", train_rows), statistics)
    sample = materialise(known.unionByName(unseen(known)).coalesce(1), "url-sample")
    n = {r.blocked: r.n for r in sample.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    weigh = F.when(F.col("blocked") == 1, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]) * sum(n.values())  # both verdicts weigh alike
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    grown = GBTClassifier(labelCol="blocked", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=32, seed=7)
    return "allow", Pipeline(stages=[assembler, grown]).fit(sample.withColumn("weight", weigh))


def scored(rows: DataFrame, model: PipelineModel, statistics: list[DataFrame]) -> DataFrame:
    """``rows`` with the trees' probability of ``block``."""
    return model.transform(with_suffixes(rows, statistics)).withColumn("score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: dict[str, str] = RULES, train_rows: int = 8000, trees: int = 8, depth: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (of the trees; null where a rule decides)."""
    rows = features(pages, rules, id_col, url_col)
    labelled = rows.filter("rule is not null")
    statistics = [materialise(s, "suffixes") for s in suffix_statistics(labelled)]
    only, model = trees_of(labelled, statistics, train_rows, trees, depth)
    columns = ["page_id", "host", "path", "rule"]
    if model is None:
        return rows.select(*columns, F.coalesce("verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    ruled = labelled.select(*columns, "verdict", F.lit(None).cast("double").alias("score"))
    judged = scored(rows.filter("rule is null"), model, statistics)
    return ruled.unionByName(judged.select(*columns, F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict"), "score"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
