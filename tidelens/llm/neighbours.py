"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

``train`` fits coarse centroids, about the square root of the number of vectors (at most ``most_lists``), and, on the
residuals in units of their list's spread, one codebook per sub-vector of at most four components (fewer where that makes
less than ``parts``), in numpy on a sample of bounded size (40 vectors a list, ``train_rows`` at least, chosen by hash).
``search`` indexes every vector: equal vectors form one class; each class goes to the list of its nearest centroid and,
there, to the shell of its distance from it (up to twice the spread, four times, and so on, so that vectors unlike any of
the sample are coded as well as others), with its codes and the exact length of what they leave over. Shells are dealt in
blocks of bounded size; vectors take no part in that, only codes are shuffled. A query's table of partial products, one
row per sub-vector, is summed over the codes (asymmetric distances).

Each query searches twice. The first time it visits the lists whose centroids have the largest inner product with it (a
quarter of ``probes``, and further lists until those visited hold ``fill`` * (k + 1) vectors or all are visited); the best
``rerank`` rows by code that reach a floor judged by the sample (without it, where fewer than k + 1 do) are joined with the
original vectors, and the k + 1st exact product is a bound that no true neighbour lies below. The second time it visits
every shell that may reach this bound, and there every row that may: a shell's products are taken to exceed its centroid's
by ``spread`` times its radius at most, a row's to exceed that of its codes by ``slack`` times what they leave over. With both
at 1 (``target`` 1) that is Cauchy's inequality, and the search exact. Otherwise they are measured: the true neighbours of
``trials`` of the queries, chosen by hash, are found by brute force over all rows, and the factors are such that (1 +
``target``) / 2 of them satisfy each. All rows found are ranked by the exact inner product, in double precision. Equal
vectors are expanded last, so a vector that a third of all rows share is one class: of its ids only the least k + 1 can
matter to any query.

Defined cases: vectors that are null, all zero, of another length than the most frequent one, or that hold null or
non-finite components take no part, neither as queries nor as candidates; ties go to the smaller id (ties of the codes,
too); rows that repeat an id count once per distinct vector; fewer candidates than k give them all; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHELLS = 64  # of a list; a cell is numbered list * SHELLS + shell


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids of the rows of ``x``; an empty one takes the row furthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        distance = (centre**2).sum(1)[None] - 2 * x @ centre.T
        own = distance.argmin(1)
        n = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[n > 0] = total[n > 0] / n[n > 0][:, None]
        far = np.argsort(-distance[np.arange(len(x)), own])
        for j, c in enumerate(np.flatnonzero(n == 0)):
            centre[c] = x[far[j % len(far)]]
    return centre


class IvfPq:
    """centre (lists, dim); books (parts, codes, width), the last components padded with zeros; probes: lists that hold
    ``target`` of a sample's neighbours; sizes: rows of each list, once all vectors are assigned; cells and radius: the
    shells that hold rows, and the largest distance from the centroid there; decoded: the sample as its codes have it;
    total: of all vectors; spread and slack: see above."""

    def __init__(self, x: np.ndarray, total: int, lists: int, parts: int = 16, codes: int = 256, k: int = 20, target: float = 0.96, rounds: int = 10, seed: int = 7):
        self.dim, self.target = x.shape[1], target
        self.width = -(-self.dim // max(min(parts, self.dim), -(-self.dim // 4)))
        self.parts = -(-self.dim // self.width)
        self.centre = kmeans(x, min(lists, len(x)), rounds, seed)
        own = self.assign(x)
        self.scale = self.spreads(x, own)
        shell = self.shells(x, own)
        residual = self.residuals(x, own, shell)
        self.books = [kmeans(np.ascontiguousarray(residual[:, p]), min(codes, len(x)), rounds, seed + p) for p in range(self.parts)]
        self.probes = self.calibrated(x, own, k, target, seed)
        self.sizes = np.bincount(own, minlength=len(self.centre))
        self.total, self.decoded = total, self.decode(self.encode(x, own, shell), own, shell).astype(np.float32)
        self.spread = self.slack = 1.0

    def spreads(self, x: np.ndarray, own: np.ndarray, least: int = 5) -> np.ndarray:
        """The median length of each list's residuals, so that near copies, too, are told apart by their codes; that of
        all where the sample has fewer than ``least`` in a list."""
        length = np.linalg.norm(x - self.centre[own], axis=1)
        every = float(np.median(length[length > 0])) if (length > 0).any() else 1.0
        order = np.argsort(own, kind="stable")
        of_list = np.split(length[order], np.cumsum(np.bincount(own, minlength=len(self.centre)))[:-1])
        return np.array([m if len(v) >= least and (m := float(np.median(v))) > 0 else every for v in of_list])

    def shells(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """0 up to twice the list's spread from its centroid, 1 up to four times, and so on."""
        ratio = np.linalg.norm(x - self.centre[own], axis=1) / self.scale[own]
        return np.clip(np.ceil(np.log2(np.maximum(ratio, 1))) - 1, 0, SHELLS - 1).astype(np.int64)

    def unit(self, own: np.ndarray, shell: np.ndarray | int) -> np.ndarray:
        """What residuals are measured in."""
        return np.ldexp(self.scale[own], shell)

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, width)"""
        return np.pad(x, ((0, 0), (0, self.parts * self.width - self.dim))).reshape(len(x), self.parts, self.width)

    def residuals(self, x: np.ndarray, own: np.ndarray, shell: np.ndarray | int = 0) -> np.ndarray:
        """(rows, parts, width), in units of the list's spread and the shell."""
        return self.split((x - self.centre[own]) / self.unit(own, shell)[:, None])

    def floors(self, q: np.ndarray, rows: int) -> np.ndarray:
        """For each query the product that about ``rows`` of all vectors should reach, judged by the sample; the least
        number where the sample is not larger than that."""
        rank = -(-rows * len(self.decoded) // self.total)
        if rank >= len(self.decoded):
            return np.full(len(q), -np.inf)
        out = [np.partition(q[a : a + 256].astype(np.float32) @ self.decoded.T, -rank, axis=1)[:, -rank] for a in range(0, len(q), 256)]
        return np.concatenate(out).astype(float)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return ((self.centre**2).sum(1)[None] - 2 * x @ self.centre.T).argmin(1)

    def probe(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists that each query visits first, one query after the other, and their numbers: a quarter of ``probes``,
        and more until they hold ``least`` rows."""
        order = np.argsort(-(q @ self.centre.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        count = np.minimum(np.maximum((held < least).sum(axis=1) + 1, -(-self.probes // 4)), len(self.centre))
        return order[np.arange(len(self.centre)) < count[:, None]], count

    def calibrated(self, x: np.ndarray, own: np.ndarray, k: int, target: float, seed: int) -> int:
        """The fewest probes that hold ``target`` of the true neighbours of some of the sample's rows."""
        q = np.random.default_rng(seed).choice(len(x), min(256, len(x)), replace=False)
        score = x[q] @ x.T
        score[np.arange(len(q)), q] = -np.inf
        near = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
        if near.shape[1] == 0:
            return len(self.centre)
        rank = np.argsort(np.argsort(-(x[q] @ self.centre.T), axis=1, kind="stable"), axis=1)
        depth = np.take_along_axis(rank, own[near], axis=1)
        share = np.array([(depth <= p).mean() for p in range(len(self.centre))])
        return int(np.argmax(share >= target)) + 1

    def reaching(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells in which a row's product with the unit vector of each query may reach its floor, one query after the
        other, and their numbers."""
        inside = (q @ self.centre.T)[:, self.cells // SHELLS] + self.spread * self.radius + self.rounding(self.cells)
        query, at = np.nonzero(inside >= floor[:, None])
        return self.cells[at], np.bincount(query, minlength=len(q))

    def rounding(self, cells: np.ndarray) -> np.ndarray:
        """More than what single precision of a unit query changes in a product with a row of these cells."""
        at = np.searchsorted(self.cells, cells)
        return 1e-6 * (np.linalg.norm(self.centre, axis=1)[cells // SHELLS] + self.radius[at])

    def encode(self, x: np.ndarray, own: np.ndarray, shell: np.ndarray | int = 0) -> np.ndarray:
        residual = self.residuals(x, own, shell)
        return np.stack([((b**2).sum(1)[None] - 2 * residual[:, p] @ b.T).argmin(1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray, shell: np.ndarray | int = 0) -> np.ndarray:
        return self.centre[lists] + self.unit(lists, shell)[:, None] * np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)[:, : self.dim]

    def approximate(self, q: np.ndarray, own: int, codes: np.ndarray, shell: int = 0) -> np.ndarray:
        """(queries, rows) asymmetric inner products with rows of a shell of list ``own``: the query is exact, the rows
        are centroid plus codes."""
        out, q = np.zeros((len(q), len(codes)), np.float32), q.astype(float)
        for p, b in enumerate(self.books):
            out += (self.split(q)[:, p] @ b.T).astype(np.float32)[:, codes[:, p]]
        return out * self.unit(own, shell) + (q @ self.centre[own])[:, None]


def classes(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """(class_id, vec, ids): distinct usable vectors with the least ``keep`` ids of each; class_id is the least."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(F.coalesce(sound, F.lit(False))).dropDuplicates(["vec_id", "vec"])
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vec") == (length.n if length else 0))
    order = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)  # taken before the shuffle, too
    return least.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("class_id"), "vec", "ids")


def train(distinct: DataFrame, train_rows: int = 8000, most_lists: int = 2048, lists: int | None = None, **how) -> IvfPq | None:
    """``lists``: as many, instead of the square root of the number of vectors."""
    total = distinct.count()
    if not total:
        return None
    lists = lists or min(most_lists, math.isqrt(total - 1) + 1)
    share = max(train_rows, 40 * lists) / total
    some = distinct.filter(F.pmod(F.xxhash64("class_id"), F.lit(1 << 40)) < share * (1 << 40)) if share < 1 else distinct
    some = some.select("class_id", "vec").toArrow().sort_by("class_id").column("vec").combine_chunks()
    if not len(some):
        return train(distinct, total, most_lists, lists, **how)
    return IvfPq(some.flatten().to_numpy().reshape(len(some), -1), total, lists, **how)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def indexed(distinct: DataFrame, model: IvfPq) -> DataFrame:
    """(cell: list and shell, class_id, code, radius: distance from the centroid, rest: length of what the codes leave
    over) of every distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), model.dim)
                own = model.assign(x)
                shell = model.shells(x, own)
                code = model.encode(x, own, shell)
                radius, rest = np.linalg.norm(x - model.centre[own], axis=1), np.linalg.norm(x - model.decode(code, own, shell), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own * SHELLS + shell, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(radius), pa.array(rest)],
                    names=["cell", "class_id", "code", "radius", "rest"],
                )

    return distinct.select("class_id", "vec").mapInArrow(run, "cell int, class_id long, code binary, radius double, rest double")


def probing(queries: DataFrame, visited: Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """(cell, class_id, q, floor): the unit vector of each query, in single precision, once for every cell that it visits.
    ``visited``, of unit vectors and their rows, gives the cells, one query after the other, their numbers, and the floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                x = units(matrix(part.column(1), len(part.column(1)[0])))
                cells, count, floor = visited(x, part)
                at = pa.array(np.repeat(np.arange(part.num_rows), count))
                q = pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), part.column(0).take(at), q.take(at), pa.array(floor).take(at)], names=["cell", "class_id", "q", "floor"])

    return queries.mapInArrow(run, "cell int, class_id long, q binary, floor double")


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def by_code(index: DataFrame, asking: DataFrame, model: IvfPq, block_rows: int, most: int | None = None) -> DataFrame:
    """(asked, found, near): for each query the rows of the cells it visits that may reach its floor; with ``most`` those
    that do by code, and of these the best."""
    turn_rows = block_rows if most else -(-block_rows // 8)  # all rows of a block may be given for each query
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # a row per cell
    loads = asking.groupBy("cell").agg(F.ceil(F.count("*") / turn_rows).cast("int").alias("turns"))
    asking = asking.join(F.broadcast(sizes), "cell").join(F.broadcast(loads), "cell").select("class_id", "q", "floor", "cell", F.pmod(F.xxhash64("class_id"), F.col("turns")).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocked = index.join(F.broadcast(sizes), "cell").join(F.broadcast(loads), "cell")
    blocked = blocked.select("class_id", "code", "rest", "cell", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))

    def match(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        asked, found, scores = [], [], []
        if len(rows):
            rows = rows.sort_values("class_id", kind="stable")
            ids = rows["class_id"].to_numpy()
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(ids), -1)
            cell = int(key[0])
            above = model.slack * rows["rest"].to_numpy() + model.rounding(np.array([cell]))
            for a in range(0, len(asks), 128):
                part = asks.iloc[a : a + 128]
                near = model.approximate(np.frombuffer(b"".join(part["q"]), np.float32).reshape(len(part), -1), cell // SHELLS, codes, cell % SHELLS)
                least = part["floor"].to_numpy()[:, None]
                if most:
                    take = min(most, len(ids))
                    q, r = np.nonzero(near >= np.maximum(np.partition(near, -take, axis=1)[:, -take][:, None], least))
                else:
                    q, r = np.nonzero(near + above >= least)
                asked.append(part["class_id"].to_numpy()[q])
                found.append(ids[r])
                scores.append(near[q, r])
        return pd.DataFrame({"asked": np.concatenate([*asked, np.zeros(0, np.int64)]), "found": np.concatenate([*found, np.zeros(0, np.int64)]), "near": np.concatenate([*scores, np.zeros(0)])})

    keys = ["cell", "block", "turn"]
    hits = blocked.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(match, "asked long, found long, near double")
    if not most:
        return hits
    best = Window.partitionBy("asked").orderBy(F.desc("near"), "found")
    return hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).drop("n")


def measured(distinct: DataFrame, queries: DataFrame, model: IvfPq, k: int, trials: int) -> tuple[float, float]:
    """``spread`` and ``slack``, from the true neighbours of ``trials`` queries among all rows."""
    some = queries.orderBy(F.xxhash64("class_id"), "class_id").limit(trials).toArrow().combine_chunks()
    if model.target >= 1 or not len(some):
        return 1.0, 1.0
    names, q = some.column("class_id").to_numpy(), units(matrix(some.column("vec").combine_chunks(), model.dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1), model.dim)
                own = model.assign(x)
                shell = model.shells(x, own)
                rest = x - model.decode(model.encode(x, own, shell), own, shell)
                score = np.where(names[:, None] == ids[None], -np.inf, q @ x.T)
                take = min(k, len(ids))
                i = np.repeat(np.arange(len(q)), take)
                r = np.argpartition(-score, take - 1, axis=1)[:, :take].reshape(-1)
                far = (q[i] * (x - model.centre[own])[r]).sum(axis=1) / np.maximum(model.radius[np.searchsorted(model.cells, own * SHELLS + shell)][r], 1e-300)
                off = (q[i] * rest[r]).sum(axis=1) / np.maximum(np.linalg.norm(rest, axis=1)[r], 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(score[i, r]), pa.array(far), pa.array(off)], names=["asked", "score", "far", "off"])

    near = distinct.select("class_id", "vec").mapInArrow(run, "asked long, score double, far double, off double").filter(F.col("score") > float("-inf"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"))
    got = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("far", "off").toArrow()  # trials * k rows
    if not len(got):
        return 1.0, 1.0
    level = (1 + model.target) / 2
    return tuple(float(min(1.0, np.quantile(got.column(c).to_numpy(), level, method="higher"))) for c in ("far", "off"))


def search(vectors: DataFrame, is_query, k: int = 20, rerank: int | None = None, fill: int = 10, block_rows: int = 4096, trials: int = 128, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that satisfy ``is_query`` (a condition on ``vec_id``), the k nearest
    of all other rows. ``rerank`` is 8 (k + 1) by default."""
    spark, need = vectors.sparkSession, k + 1  # one may be the query itself
    rerank = max(need, rerank or 8 * need)
    distinct = materialise(classes(vectors, id_col, vector_col, need), "vectors")
    model = train(distinct, k=k, **how)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).filter(is_query).dropDuplicates(["vec_id", "vec"])
    asked = materialise(distinct.join(wanted, "vec").select("class_id", F.col("vec_id").alias("query_id")), "queries")
    queries = materialise(distinct.join(asked.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "vec"), "query-vectors")
    index = materialise(indexed(distinct, model), "ivf")
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).orderBy("cell").toPandas()  # a row per cell
    model.cells, model.radius = cells["cell"].to_numpy(np.int64), cells["radius"].to_numpy()
    model.sizes = np.bincount(model.cells // SHELLS, cells["n"], len(model.centre)).astype(np.int64)
    model.spread, model.slack = measured(distinct, queries, model, k, trials)

    product = F.aggregate(F.zip_with("vec", "query", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "found")

    def exact(hits: DataFrame) -> DataFrame:
        pairs = hits.join(distinct.select(F.col("class_id").alias("found"), "vec"), "found").join(queries.select(F.col("class_id").alias("asked"), F.col("vec").alias("query")), "asked")
        return pairs.select("asked", "found", product.alias("score")).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= need)

    def first(x: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, count = model.probe(x, fill * need)
        low, high = np.searchsorted(model.cells, lists * SHELLS), np.searchsorted(model.cells, (lists + 1) * SHELLS)
        at = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange((high - low).sum())
        return model.cells[at], np.add.reduceat(high - low, np.r_[0, np.cumsum(count)[:-1]]), model.floors(x, 2 * rerank)

    def second(x: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        floor = part.column(2).to_numpy() / np.linalg.norm(matrix(part.column(1), model.dim), axis=1)
        return *model.reaching(x, floor), floor

    asking = materialise(probing(queries, first), "probes")
    hits = materialise(by_code(index, asking, model, block_rows, rerank), "hits")
    enough = hits.groupBy(F.col("asked").alias("class_id")).count().filter(F.col("count") >= min(need, model.total)).select("class_id")
    short = materialise(asking.join(enough, "class_id", "left_anti").withColumn("floor", F.lit(float("-inf"))), "probes")
    if not short.isEmpty():
        again = by_code(index, short, model, block_rows, rerank)
        hits = hits.join(short.select(F.col("class_id").alias("asked")).distinct(), "asked", "left_anti").unionByName(again)
    ranked = materialise(exact(hits), "reranked")
    # no true neighbour lies below the k + 1st that was found; fewer tell nothing
    bound = ranked.filter(F.col("n") == need).select(F.col("asked").alias("class_id"), F.col("score").alias("floor"))
    bounded = queries.join(bound, "class_id", "left").select("class_id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    hits = materialise(by_code(index, materialise(probing(bounded, second), "probes"), model, block_rows), "hits")
    found = materialise(ranked.drop("n").union(exact(hits.select("asked", "found")).drop("n")).distinct().withColumn("n", F.row_number().over(best)).filter(F.col("n") <= need).drop("n"), "reranked")
    least = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    members = found.join(distinct.select(F.col("class_id").alias("found"), "ids"), "found").select("asked", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(least)).filter(F.col("n") <= need)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = members.join(asked.withColumnRenamed("class_id", "asked"), "asked").filter("vec_id <> query_id").select("query_id", "vec_id", "score")
    return pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
