"""Hard negatives by a GNAT-style tree of hyperplanes, exact.

Vectors are whole numbers (``floor(scale * x)``); a score is an inner product. Rows with equal vector and label form one
class, of which the least ids are kept, as many as any answer can hold. The tree is fitted on a sample of bounded size:
a node has ``branch`` split points far from each other, and a vector goes to the nearest one, that is, to its side of the
hyperplanes between them, down to the leaves. All classes are then sent to their leaves, and for each child of a node the
least and largest distance from *every* split point of that node to all rows below the child is taken, with the range of
their squared norms. These are exact over all rows, whatever the sample was.

An anchor asks for a window of scores. With squared norms between u and v, a score between s and t means a distance from
the anchor between sqrt(|a|^2 + u - 2 t) and sqrt(|a|^2 + v - 2 s): an annulus. By the triangle inequality the rows below a
child lie within [max |d(a, p) outside the child's range of p|, min d(a, p) + upper end] for all split points p; a child
whose interval does not meet an annulus is left out with all below it. Leaves that remain are searched exactly, in blocks
of bounded size. Windows are narrow from the start: the sample's rows, which are rows like any other, already bound the
k-th score from below.

Two rounds: the ``positives`` best other rows of an anchor's label; then, for each distinct score p among them, the best
rows of other labels with scores from ``percent`` % of p to p. Anchors that are equal ask once.

Defined cases: rows whose id, label or vector is null, or whose vector is empty, has another length than most (the
shorter on ties) or holds null or non-finite components, take no part; equal rows count once; rows of an anchor's own id
are never its positives; ties go to the smaller id; an anchor without positives, or a positive without negatives, gives
no row; zero vectors count; empty tables give no rows; other columns are ignored. Products are exact below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SLACK = 1e-9  # of the distances at hand: more than their rounding


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * x @ points.T, 0))


class Gnat:
    """points: split points of each node; below: for each node the numbers of its children. Child c is a node (node_of[c])
    or a leaf (node_of[c] = -1, leaf_of[c]). low, high (children, branch), norms (children, 2): set by ``ranged``."""

    def __init__(self, x: np.ndarray, leaf_rows: float, branch: int = 8, seed: int = 11):
        self.rng, self.branch = np.random.default_rng(seed), branch
        self.points: list[np.ndarray] = []
        self.below: list[list[int]] = []
        self.node_of, self.leaf_of, self.leaves = [-1], [0], 1
        self.root = self.grow(x, max(leaf_rows, branch), depth=24)
        self.dim = x.shape[1]
        self.low = np.full((len(self.node_of), branch), np.inf)
        self.high, self.norms = -self.low, np.tile([np.inf, -np.inf], (len(self.node_of), 1))

    def grow(self, x: np.ndarray, leaf_rows: float, depth: int) -> int:
        """Node over the rows of ``x``, or -1 if they make a leaf."""
        points = self.far_apart(x) if len(x) > leaf_rows and depth else x[:1]
        if len(points) < 2:
            return -1
        node = len(self.points)
        self.points.append(points)
        self.below.append([])
        own = distances(x, points).argmin(1)
        for j in range(len(points)):
            c = len(self.node_of)
            self.below[node].append(c)
            self.node_of.append(-1)
            self.leaf_of.append(-1)
            self.node_of[c] = self.grow(x[own == j], leaf_rows, depth - 1)
            if self.node_of[c] < 0:
                self.leaf_of[c], self.leaves = self.leaves, self.leaves + 1
        return node

    def far_apart(self, x: np.ndarray) -> np.ndarray:
        """Of 4 * branch random rows, ``branch`` distinct ones, each the furthest from those before it."""
        some = x[self.rng.choice(len(x), min(4 * self.branch, len(x)), replace=False)]
        chosen, nearest = [0], distances(some, some[:1])[:, 0]
        while len(chosen) < self.branch and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(child, rows of x that go there, their distances to all split points of the node)."""
        todo = [(self.root, np.arange(len(x)))] if self.root >= 0 else []
        while todo:
            node, rows = todo.pop()
            d = distances(x[rows], self.points[node])
            own = d.argmin(1)
            for j, c in enumerate(self.below[node]):
                here = own == j
                if here.any():
                    yield c, rows[here], d[here]
                    if self.node_of[c] >= 0:
                        todo.append((self.node_of[c], rows[here]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for c, rows, _ in self.walk(x):
            if self.node_of[c] < 0:
                out[rows] = self.leaf_of[c]
        return out

    def widen(self, x: np.ndarray) -> None:
        norm = (x**2).sum(1)
        for c, rows, d in self.walk(x):
            m = d.shape[1]
            self.low[c, :m], self.high[c, :m] = np.minimum(self.low[c, :m], d.min(0)), np.maximum(self.high[c, :m], d.max(0))
            self.norms[c] = min(self.norms[c, 0], norm[rows].min()), max(self.norms[c, 1], norm[rows].max())

    def visited(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for all leaves that may hold a score in one of the query's windows; least, most (queries, windows),
        NaN where a query has fewer."""
        norm, asked, leaves = (q**2).sum(1), [], []
        todo = [(self.root, np.arange(len(q)))]
        if self.root < 0:
            return np.arange(len(q)), np.zeros(len(q), np.int64)
        while todo:
            node, rows = todo.pop()
            d = distances(q[rows], self.points[node])
            m = d.shape[1]
            for c in self.below[node]:
                u, v = self.norms[c]
                if not u <= v:
                    continue  # no row went there
                slack = SLACK * (d.max() + self.high[c, :m].max())
                near = np.maximum(np.maximum(self.low[c, :m] - d, d - self.high[c, :m]).max(1), 0) - slack
                far = (d + self.high[c, :m]).min(1) + slack
                with np.errstate(invalid="ignore"):  # NaN meets nothing
                    inner = np.sqrt(np.maximum(norm[rows, None] + u - 2 * most[rows], 0))
                    outer = np.sqrt(norm[rows, None] + v - 2 * least[rows])  # NaN, too, where no row has so large a score
                    meet = ((near[:, None] <= outer) & (inner <= far[:, None])).any(1)
                if meet.any():
                    if self.node_of[c] >= 0:
                        todo.append((self.node_of[c], rows[meet]))
                    else:
                        asked.append(rows[meet])
                        leaves.append(np.full(int(meet.sum()), self.leaf_of[c]))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(asked or empty), np.concatenate(leaves or empty)


def classes(vectors: DataFrame, keep: int, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(no, class_id, label, vec, ids): distinct usable (vector, label) with the least ``keep`` ids; class_id is the least.
    ``no`` names a class; it is settled once the table is written."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("vec", F.transform(v, lambda x: F.floor(x * float(scale)).cast("double"))).dropDuplicates(["vec_id", "label", "vec"])
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vec") == (length.n if length else 0))
    order = Window.partitionBy("vec", "label").orderBy("vec_id")
    least = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)  # taken before the shuffle, too
    return least.groupBy("vec", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("no"), F.element_at("ids", 1).alias("class_id"), "label", "vec", "ids")


class Sample:
    """Classes (x, label, no) that bound scores from below, and the tree."""

    def __init__(self, distinct: DataFrame, rows: int, leaf_rows: int, branch: int):
        total = distinct.count()
        share = rows / max(1, total)
        some = distinct.filter(F.pmod(F.xxhash64("class_id", "label"), F.lit(1 << 40)) < share * (1 << 40)) if share < 1 else distinct
        some = some.select("no", "class_id", "label", "vec").toArrow().sort_by([("class_id", "ascending"), ("label", "ascending")])
        self.total, self.no, self.label = total, some.column("no").to_numpy(), some.column("label").to_numpy()
        self.x = some.column("vec").combine_chunks().flatten().to_numpy().reshape(len(self.label), -1) if len(self.label) else np.zeros((0, 1))
        self.tree = Gnat(self.x, leaf_rows * len(self.x) / max(1, total), branch) if len(self.x) else None

    def floors(self, q: np.ndarray, label: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """A score that at least k rows of the same label, outside the query's class, reach."""
        out = np.full(len(q), -np.inf)
        if len(self.x) >= k:
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ self.x.T
                s[(label[a : a + 256, None] != self.label) | (own[a : a + 256, None] == self.no)] = -np.inf
                out[a : a + 256] = np.partition(s, -k, axis=1)[:, -k]
        return out

    def window_floors(self, q: np.ndarray, label: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
        """``least``, or more where at least k rows of other labels lie between that and ``most``."""
        out = least.copy()
        if len(self.x) >= k:
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ self.x.T
                s[label[a : a + 256, None] == self.label] = -np.inf
                for w in range(least.shape[1]):
                    with np.errstate(invalid="ignore"):
                        top = np.partition(np.where(s <= most[a : a + 256, w, None], s, -np.inf), -k, axis=1)[:, -k]
                        out[a : a + 256, w] = np.fmax(out[a : a + 256, w], np.where(np.isnan(out[a : a + 256, w]), np.nan, top))
        return out


def matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def indexed(distinct: DataFrame, tree: Gnat, kind: type) -> DataFrame:
    """(leaf, no, class_id, label, vec) of every class, vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(3), batch.num_rows)
                packed = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(x)), *batch.columns[:3], packed], names=["leaf", "no", "class_id", "label", "vec"])

    return distinct.select("no", "class_id", "label", "vec").mapInArrow(run, "leaf long, no long, class_id long, label long, vec binary")


def ranged(distinct: DataFrame, tree: Gnat) -> None:
    """Sets the tree's ranges from all rows; a task sends a row for each child and split point that it met."""
    if tree.root < 0:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tree.widen(matrix(batch.column(0), batch.num_rows))
        c, i = np.nonzero(tree.high >= tree.low)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c, i, tree.low[c, i], tree.high[c, i], tree.norms[c, 0], tree.norms[c, 1])], names=["c", "i", "low", "high", "u", "v"])

    parts = distinct.select("vec").mapInArrow(run, "c long, i long, low double, high double, u double, v double")
    for r in parts.groupBy("c", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("u").alias("u"), F.max("v").alias("v")).collect():  # bounded by the tree
        tree.low[r.c, r.i], tree.high[r.c, r.i], tree.norms[r.c] = r.low, r.high, (r.u, r.v)


TOGETHER, SENT = 256, 2 << 20  # asks that look for their leaves at once; bytes of vectors in a batch that goes out
ASKING = "leaf long, no long, label long, vec binary, least array<double>, most array<double>"


def asking(asks: DataFrame, sample: Sample, kind: type, k: int, percent: int | None) -> DataFrame:
    """Each ask, once for every leaf that it must visit. Without ``percent``: for scores of its label from a floor on; with
    it: for those of other labels within its windows, from that share of each of ``scores`` up to the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):  # an ask may visit all leaves
                yield from asked(whole.slice(first, TOGETHER))

    def asked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, label, own = matrix(batch.column(2), batch.num_rows), batch.column(1).to_numpy(), batch.column(0).to_numpy()
        if percent is None:
            least, most = sample.floors(q, label, own, k)[:, None], np.full((len(q), 1), np.inf)
        else:
            scores = batch.column(3).to_pylist()
            most = np.full((len(q), max(map(len, scores))), np.nan)
            for r, s in enumerate(scores):
                most[r, : len(s)] = s
            least = sample.window_floors(q, label, np.ceil(percent * most / 100), most, k)
        at, leaves = sample.tree.visited(q, least, most)
        packed = pa.array([v.tobytes() for v in q.astype(kind)], pa.binary())
        lists = [pa.array([[None if np.isnan(v) else v for v in row] for row in w], pa.list_(pa.float64())) for w in (least, most)]
        columns, step = [batch.column(0), batch.column(1), packed, *lists], max(1, SENT // (q.shape[1] * np.dtype(kind).itemsize))
        for a in range(0, len(at), step):
            pick = pa.array(at[a : a + step])
            yield pa.RecordBatch.from_arrays([pa.array(leaves[a : a + step]), *[c.take(pick) for c in columns]], names=["leaf", "no", "label", "vec", "least", "most"])

    return asks.mapInArrow(run, ASKING)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite entries of each row, ties to the first columns."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
    r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    turn = np.arange(len(r)) - np.searchsorted(r, r)
    return r[turn < k], c[turn < k]


def searched(index: DataFrame, asks: DataFrame, kind: type, k: int, same: bool, block_rows: int) -> DataFrame:
    """(asked, window, found, class_id, score): the best k classes for each ask and window."""
    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # a row per leaf
    loads = asks.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("turns"))
    turn_of, block_of = F.pmod(F.xxhash64("no"), F.col("turns")).cast("int").alias("turn"), F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int").alias("block")
    bounds = sizes.join(F.broadcast(loads), "leaf")
    asked = asks.join(F.broadcast(bounds), "leaf").select("leaf", "no", "label", "vec", "least", "most", turn_of, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = index.join(F.broadcast(bounds), "leaf").select("leaf", "no", "class_id", "label", "vec", block_of, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))

    def unpacked(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(float)

    def windows(column: pd.Series) -> np.ndarray:
        return np.array([np.asarray(v, float) for v in column]).reshape(len(column), -1)

    def match(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("asked", "window", "found", "class_id", "score")}
        if len(rows) and len(asks):
            rows = rows.sort_values(["class_id", "no"], kind="stable")
            x, no, ids, labels = unpacked(rows["vec"]), rows["no"].to_numpy(), rows["class_id"].to_numpy(), rows["label"].to_numpy()
            for width, part in asks.groupby(asks["most"].map(len)):
                for a in range(0, len(part), 128):
                    some = part.iloc[a : a + 128]
                    own, label, least, most = some["no"].to_numpy(), some["label"].to_numpy(), windows(some["least"]), windows(some["most"])
                    s = unpacked(some["vec"]) @ x.T
                    s[(label[:, None] == labels) != same] = -np.inf
                    for w in range(width):
                        fit = np.where((s <= most[:, w, None]) & (s >= least[:, w, None]), s, -np.inf)
                        r, c = best_of(fit, k)
                        for name, v in (("asked", own[r]), ("window", most[r, w]), ("found", no[c]), ("class_id", ids[c]), ("score", s[r, c])):
                            out[name].append(v)
        kinds = {"window": float, "score": float}
        return pd.DataFrame({n: np.concatenate([*v, np.zeros(0, kinds.get(n, np.int64))]) for n, v in out.items()})

    keys = ["leaf", "block", "turn"]
    hits = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(match, "asked long, window double, found long, class_id long, score double")
    best = Window.partitionBy("asked", "window").orderBy(F.desc("score"), "class_id", "found")
    return hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def members(hits: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """The best k rows of the classes that were found: (asked, window, vec_id, score, turn)."""
    rows = hits.join(distinct.select(F.col("no").alias("found"), "ids"), "found").select("asked", "window", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("asked", "window").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, sample_rows: int = 8192, leaf_rows: int = 1024, branch: int = 8, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for the rows that satisfy ``is_anchor`` (a
    condition on ``vec_id``) and each of their positives, the best negatives within the window below it."""
    spark, need = vectors.sparkSession, positives + 1  # one may be the anchor itself
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    distinct = materialise(classes(vectors, max(need, negatives), scale, id_col, vector_col, label), "vectors")
    sample = Sample(distinct, sample_rows, leaf_rows, branch)
    if not sample.total:
        return spark.createDataFrame([], result)
    if sample.tree is None:
        return mine(vectors, is_anchor, label, positives, negatives, percent, scale, sample.total, leaf_rows, branch, block_rows, id_col, vector_col)
    ranged(distinct, sample.tree)
    top = distinct.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    kind = np.float32 if top <= 1 << 24 else np.float64
    index = materialise(indexed(distinct, sample.tree, kind), "gnat")
    wanted = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("double")).alias("vec"))
    wanted = wanted.filter(is_anchor).dropDuplicates(["vec_id", "label", "vec"])
    anchors = materialise(distinct.join(wanted, ["vec", "label"]).select("no", F.col("vec_id").alias("anchor_id")), "anchors")
    askers = materialise(distinct.join(anchors.select("no").distinct(), "no", "left_semi").select("no", "label", "vec"), "askers")

    asks = materialise(asking(askers, sample, kind, positives, None), "asks")
    near = materialise(members(searched(index, asks, kind, need, True, block_rows), distinct, need), "near", asks)
    own = Window.partitionBy("anchor_id", "no").orderBy(F.desc("score"), "vec_id")
    pairs = near.withColumnRenamed("asked", "no").join(anchors, "no").filter("vec_id <> anchor_id")
    pairs = pairs.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= positives)
    pairs = materialise(pairs.select("anchor_id", "no", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives", near)

    scores = pairs.filter("positive_score >= 0").groupBy("no").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    asks = materialise(asking(askers.join(scores, "no").select("no", "label", "vec", "scores"), sample, kind, negatives, percent), "asks")
    hard = members(searched(index, asks, kind, negatives, False, block_rows), distinct, negatives)
    hard = hard.select(F.col("asked").alias("no"), F.col("window").alias("positive_score"), F.col("turn").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = pairs.join(hard, ["no", "positive_score"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
