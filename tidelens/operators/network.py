"""Networks: similarity edges, thresholds, degrees, distances, paths, community peeling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import ordering
from tidelens.functions.scalar import great_circle, planar_degrees, ratio
from tidelens.functions.storage import cut_lineage, scratch


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors (node, vec) without nulls that are not constant."""
    mean = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x) / F.size("vec")
    sound = vectors.filter(F.col("node").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull())).withColumn("m", mean)
    return sound.filter(F.exists("vec", lambda x: x != F.col("m"))).select("node", F.col("vec").cast("array<double>").alias("vec"))


def packed(vectors: DataFrame, block: int) -> DataFrame:
    """(at, ids, x): blocks of up to ``block`` vectors (node, vec), standardised, as bytes; a block is one row of a table in
    the shared folder. Vectors with nulls and constant ones take no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = np.zeros(0, np.int64), None
        for pdf in batches:
            if len(pdf):
                ids, new = np.concatenate([ids, pdf["node"].to_numpy()]), standardised(pdf["vec"])
                x = new if x is None else np.concatenate([x, new])
            while len(ids) >= block:
                yield pd.DataFrame({"ids": [ids[:block].tobytes()], "x": [x[:block].tobytes()]})
                ids, x = ids[block:], x[block:]
        if len(ids):
            yield pd.DataFrame({"ids": [ids.tobytes()], "x": [x.tobytes()]})

    sound = usable(vectors)
    dealt = sound.repartition(max(1, -(-sound.count() // (8 * block))), "node").select(F.col("node").cast("long").alias("node"), "vec")
    return cut_lineage(dealt.mapInPandas(run, "ids binary, x binary").select(F.monotonically_increasing_id().alias("at"), "ids", "x"))


def pairs_of(blocks: DataFrame, may: Callable[[], Column] | None = None) -> DataFrame:
    """Every two blocks once, and each with itself; columns end in a and b. A Cartesian product of the table's partitions:
    tasks read both sides from the shared folder, so that no row is shuffled and disk does not grow with the pairs."""
    a, b = (blocks.select(*[F.col(c).alias(c + end) for c in blocks.columns]) for end in "ab")
    once = (F.col("ata") == F.col("atb")) | ((F.col("ata") < F.col("atb")) == ((F.col("ata") + F.col("atb")) % 2 == 1))
    return a.hint("shuffle_replicate_nl").join(b, once if may is None else once & may())


class Block:
    """Of a row of a table of blocks: ids, x; low, high: ranges of angles to pivots of each ``part`` rows, if it has them."""

    def __init__(self, row: dict, end: str):
        self.at, self.ids = row["at" + end], np.frombuffer(row["ids" + end], np.int64)
        self.x = np.frombuffer(row["x" + end]).reshape(len(self.ids), -1)
        self.low, self.high = (np.frombuffer(row[c + end]).reshape(-1, row["pivots" + end]) if c + end in row else None for c in ("lows", "highs"))


Tile = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def tiles(a: Block, b: Block, tau: float | None = None, part: int = 64) -> Iterator[Tile]:
    """(ids, ids, correlations, which of them are of pairs; None: all) of strips of ``a`` with ``b``, each pair once. With
    ``tau``, of blocks with ranges, only parts that may hold a correlation above ``tau`` or below -tau. The next strip's
    correlations take the place of the last one's."""
    room = np.empty(min(part, len(a.ids)) * len(b.ids))
    own = a.at == b.at
    shared = own or len(np.intersect1d(a.ids, b.ids))
    reach = None if tau is None else may_reach(a, b, tau)
    for k, s in enumerate(range(0, len(a.ids), part)):
        left, ids, x = a.ids[s : s + part], b.ids, b.x
        if reach is not None and not reach[k].all():
            columns = np.repeat(reach[k], part)[: len(ids)]
            ids, x = ids[columns], x[columns]
        if len(ids):
            r = np.matmul(a.x[s : s + part], x.T, out=room[: len(left) * len(ids)].reshape(len(left), -1))
            yield left, ids, r, None if not shared else left[:, None] < ids if own else left[:, None] != ids


def of_pairs(pairs: DataFrame, run: Callable[[Iterator[tuple[Block, Block]]], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """What ``run`` makes of the pairs of blocks of a task, in batches of columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[Block, Block]]:
            for batch in batches:
                for k in range(batch.num_rows):  # a view of the bytes, not a copy
                    row = {n: (c[k].as_buffer() if pa.types.is_binary(c.type) else c[k].as_py()) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                    yield Block(row, "a"), Block(row, "b")

        for out in run(blocks()):
            yield pa.RecordBatch.from_pydict(out)

    return pairs.mapInArrow(task, schema)


def gathered(parts: Iterator[dict[str, np.ndarray]], rows: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """``parts`` put together to batches of some ``rows``."""
    held: list[dict[str, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(next(iter(x.values()))) for x in held) >= rows:
            yield {c: np.concatenate([x[c] for x in held]) for c in part}
            held = []
    if held:
        yield {c: np.concatenate([x[c] for x in held]) for c in held[0]}


def linked(pairs: DataFrame, test: Callable[[np.ndarray], np.ndarray], both: bool, digits: int | None = None, tau: float | None = None, part: int = 64) -> DataFrame:
    """(i, j, w) of the pairs whose correlation passes ``test``, i < j or ``both`` ways; w rounded to ``digits``."""

    def run(blocks: Iterator[tuple[Block, Block]]) -> Iterator[dict[str, np.ndarray]]:
        for a, b in blocks:
            for left, right, r, of in tiles(a, b, tau, part):
                at = np.flatnonzero(test(r) if of is None else test(r) & of)
                if len(at):
                    u, v, w = left[at // r.shape[1]], right[at % r.shape[1]], r.ravel()[at]
                    w = w if digits is None else np.round(w, digits)
                    if both:
                        yield {"i": np.concatenate([u, v]), "j": np.concatenate([v, u]), "w": np.concatenate([w, w])}
                    else:
                        yield {"i": np.minimum(u, v), "j": np.maximum(u, v), "w": w}

    return of_pairs(pairs, lambda blocks: gathered(run(blocks)), "i long, j long, w double")


def similarity_blocks(vectors: DataFrame, block: int = 2048, least: float | None = None, absolute: bool = False) -> DataFrame:
    """(i, j, w) for i < j: Pearson correlation of equally long vectors (node, vec). Only entries above ``least`` leave
    the tasks."""
    test = (lambda r: np.ones(r.shape, bool)) if least is None else beyond(least) if absolute else lambda r: r > least
    return linked(pairs_of(packed(vectors, block)), test, both=False)


def beyond(tau: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda r: (r > tau) | (r < -tau) if tau >= 0 else np.ones(r.shape, bool)


def similar_links(vectors: DataFrame, threshold: float, digits: int, block: int = 2048) -> DataFrame:
    """(i, j) both ways of pairs whose correlation, rounded to ``digits``, is at or above the threshold."""
    near = threshold - 10.0**-digits
    return linked(pairs_of(packed(vectors, block)), lambda r: r > near, both=True, digits=digits).filter(F.col("w") >= threshold).select("i", "j")


class Pivots:
    """Unit vectors far from each other, of a sample of bounded size; angles to them bound angles between other vectors."""

    def __init__(self, sample: np.ndarray, count: int):
        chosen = [0]
        best = sample @ sample[0]
        while len(chosen) < min(count, len(sample)) and best.min() < 1 - 1e-9:
            chosen.append(int(best.argmin()))
            best = np.maximum(best, sample @ sample[chosen[-1]])
        self.x = sample[chosen]

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.x.T, -1, 1))


def standardised(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def may_reach(a: Block, b: Block, tau: float) -> np.ndarray:
    """(parts of a, parts of b): whether their ranges of angles allow a correlation above ``tau`` or below -tau."""
    apart = np.maximum((a.low[:, None] - b.high[None]).max(2), (b.low[None] - a.high[:, None]).max(2))
    wide = np.minimum((a.high[:, None] + b.high[None]).min(2), 2 * np.pi - (a.low[:, None] + b.low[None]).max(2))
    return (np.cos(np.clip(apart - 1e-7, 0, np.pi)) > tau) | (np.cos(np.clip(wide + 1e-7, 0, np.pi)) < -tau)


def reaching_blocks(vectors: DataFrame, tau: float, pivots: int, block: int, sample_rows: int = 4096, most_rows: int = 1024) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, pairs, all): vectors dealt by their nearest pivot and the angle to it, ``block`` a part, parts of one pivot
    up to ``most_rows`` together; the pairs of blocks that may hold a correlation above ``tau`` or below -tau; and the number
    of all pairs of blocks.

    Of two blocks, |a - b| <= angle <= min(a + b, 2 pi - a - b) for the angles a, b of their members to each pivot; ranges
    of these, exact over all members, bound the correlation: first of blocks, then (``may_reach``) of their parts.
    """
    spark, sound = vectors.sparkSession, usable(vectors).withColumn("node", F.col("node").cast("long"))
    total, together = sound.count(), block * max(1, most_rows // block)
    schema = "at long, ids binary, x binary, pivots int, lows binary, highs binary, low array<double>, high array<double>"
    share = sample_rows / max(1, total)
    some = sound.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < share * (1 << 40)) if share < 1 else sound
    some = (some if not some.isEmpty() else sound).toPandas().sort_values("node")
    if not len(some):
        none = spark.createDataFrame([], schema)
        return none, pairs_of(none), 0
    near = Pivots(standardised(some["vec"]), pivots)

    def dealt(batches):
        for pdf in batches:
            if len(pdf):
                angle = near.angles(standardised(pdf["vec"]))
                yield pdf.assign(c=angle.argmin(axis=1).astype(np.int32), angle=angle.min(axis=1))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        x = standardised(rows["vec"])
        angle, starts = near.angles(x), np.arange(0, len(x), block)
        low, high = np.minimum.reduceat(angle, starts), np.maximum.reduceat(angle, starts)
        return pd.DataFrame({"at": [int(rows["place"].iloc[0])], "ids": [rows["node"].to_numpy().tobytes()], "x": [x.tobytes()], "pivots": [angle.shape[1]], "lows": [low.tobytes()], "highs": [high.tobytes()], "low": [low.min(axis=0)], "high": [high.max(axis=0)]})

    rows = ordering.placed(sound.mapInPandas(dealt, "node long, vec array<double>, c int, angle double"), "c", "angle", "node")
    blocks = cut_lineage(rows.groupBy("c", F.floor(F.col("place") / together).alias("q")).applyInPandas(pack, schema))

    def may() -> Column:
        apart = F.greatest(F.array_max(F.zip_with("lowa", "highb", lambda x, y: x - y)), F.array_max(F.zip_with("lowb", "higha", lambda x, y: x - y)), F.lit(0.0))
        wide = F.least(F.array_min(F.zip_with("higha", "highb", lambda x, y: x + y)), 2 * math.pi - F.array_max(F.zip_with("lowa", "lowb", lambda x, y: x + y)), F.lit(math.pi))
        return (F.cos(F.greatest(F.lit(0.0), apart - 1e-7)) > tau) | (F.cos(F.least(F.lit(math.pi), wide + 1e-7)) < -tau)

    n = blocks.count()
    return blocks, pairs_of(blocks, may), n * (n + 1) // 2


def pruned_similarity(vectors: DataFrame, tau: float, pivots: int = 64, block: int = 1024, both: bool = False, digits: int | None = None) -> DataFrame:
    """(i, j, w), i < j, |w| > tau: as ``similarity_blocks``, but only pairs of blocks that may reach tau are multiplied."""
    return linked(reaching_blocks(vectors, tau, pivots, block)[1], beyond(tau), both, digits, tau, block)


def correlation_edges(vectors: DataFrame, tau: float, block: int = 2048, giant: bool = False, pivots: int | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, w) both ways where |r| > tau; ``giant``: of the largest connected component only. With ``pivots``, pairs of
    blocks that cannot reach tau are left out, which pays where series come in groups."""
    if giant:
        pairs = pairs_of(packed(vectors, block)) if pivots is None else reaching_blocks(vectors, tau, pivots, block)[1]
        vectors = vectors.join(giant_nodes(spanning_links(pairs, beyond(tau))).withColumnRenamed("i", "node"), "node", "left_semi")
    if pivots is not None:
        return pruned_similarity(vectors, tau, pivots, block, True, digits)
    return linked(pairs_of(packed(vectors, block)), beyond(tau), True, digits)


class Forest:
    """Trees over the rows of blocks; ``root`` of each row."""

    def __init__(self):
        self.root, self.ids, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), {}

    def rows(self, block: Block) -> np.ndarray:
        if block.at not in self.first:
            self.first[block.at] = len(self.root)
            self.root = np.concatenate([self.root, len(self.root) + np.arange(len(block.ids))])
            self.ids = np.concatenate([self.ids, block.ids])
        return self.first[block.at] + np.arange(len(block.ids))

    def join(self, a: np.ndarray, b: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """Of the links between rows a and b, those that join two trees. A root goes below a lesser one, so none goes round."""
        while True:
            p, q = self.root[a], self.root[b]
            apart = p != q
            if not apart.any():
                return
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            high, first = np.unique(np.maximum(p, q), return_index=True)
            self.root[high] = np.minimum(p, q)[first]
            yield {"i": self.ids[a[first]], "j": self.ids[b[first]]}
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def spanning_links(pairs: DataFrame, test: Callable[[np.ndarray], np.ndarray], part: int = 256) -> DataFrame:
    """(i, j): links that connect what all links of the pairs of blocks connect, fewer than a task has rows from each task.
    Rows that are known to be in one tree are not multiplied any more."""

    def run(blocks: Iterator[tuple[Block, Block]]) -> Iterator[dict[str, np.ndarray]]:
        forest = Forest()
        for a, b in blocks:
            left, right = forest.rows(a), forest.rows(b)
            known, count = np.unique(forest.root[left], return_counts=True)
            tree = known[count.argmax()]
            inside, out = forest.root[left] == tree, forest.root[right] != tree
            for rows, columns in ((np.arange(len(left)), np.flatnonzero(out)), (np.flatnonzero(~inside), np.flatnonzero(~out))):
                x = b.x[columns]
                for s in range(0, len(rows) if len(columns) else 0, part):
                    some = rows[s : s + part]
                    at = np.flatnonzero(test(a.x[some] @ x.T))
                    yield from forest.join(left[some[at // len(columns)]], right[columns[at % len(columns)]])

    return of_pairs(pairs, lambda blocks: gathered(run(blocks)), "i long, j long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of undirected edges (i, j): the least node of its component. Each round takes the
    least label of the neighbours and then that label's own label, so rounds grow with the logarithm of the diameter."""
    both = cut_lineage(edges.select("i", "j").union(edges.select("j", "i")).distinct())
    labels = table = cut_lineage(both.groupBy(F.col("i").alias("node")).agg(F.least(F.first("i"), F.min("j")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, both.j == labels.node).groupBy(F.col("i").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut_lineage(lower.join(root, "label").select("node", F.least("label", "further").alias("label"), "old"), instead_of=table)
        table, labels = new, new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def giant_nodes(edges: DataFrame) -> DataFrame:
    """(i): the nodes of the component with the most nodes (ties: the least label)."""
    with scratch(edges.sparkSession) as keep:
        labels = components(edges)
        largest = labels.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        return keep(cut_lineage(labels.join(F.broadcast(largest), "label").select(F.col("node").alias("i"))))  # one row is broadcast


def giant_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with the most nodes (ties: the least label)."""
    return edges.join(giant_nodes(edges), "i").select(*edges.columns)


def adjacency(sim: DataFrame, threshold: float) -> DataFrame:
    """Links of signed similarity at or above the threshold, without the diagonal."""
    return sim.filter((F.col("w") >= threshold) & (F.col("i") != F.col("j"))).select("i", "j")


def edge_density(sim: DataFrame, bins: int) -> DataFrame:
    """(bin, threshold, density): share of pairs i < j with |w| at or above each of bins + 1 edges from 0 to the greatest."""
    pairs = sim.filter("i < j and w is not null").select(F.abs("w").alias("w"))
    top = pairs.agg(F.max("w").alias("top"), F.count("*").alias("nn"))
    counts = pairs.crossJoin(F.broadcast(top)).groupBy(F.least(F.lit(bins - 1), F.floor(F.coalesce(ratio(F.col("w") * bins, "top"), F.lit(0.0)))).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = sim.sparkSession.range(bins + 1).select(F.col("id").alias("bin")).join(counts, "bin", "left").crossJoin(F.broadcast(top))  # one row per bin
    tail = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("bin", (F.col("bin") * F.col("top") / bins).alias("threshold"), (tail / F.col("nn")).alias("density"))


def threshold_of_density(sim: DataFrame, rho: float, n_nodes: int | None = None, diagonal: bool = True) -> DataFrame:
    """One row: the entry at index floor((1 - rho)(N^2 - N)) of all N^2 ascending entries.

    ``sim`` holds i < j; the symmetric half and, with ``diagonal``, N ones are implied. Equal entries are counted
    together, so the order statistic comes from running counts of distinct values instead of a sort of all entries.
    """
    n = n_nodes if n_nodes is not None else sim.select(F.explode(F.array("i", "j")).alias("v")).distinct().count()
    at = int((1 - rho) * (n * n - n))
    values = sim.filter("w is not null").groupBy("w").agg((F.count("*") * 2).alias("c"))
    if diagonal:
        values = values.unionByName(sim.sparkSession.createDataFrame([(1.0, n)], "w double, c long")).groupBy("w").agg(F.sum("c").alias("c"))
    part = F.floor(F.col("w") * 512)  # running counts within slices of the value range, offsets over the slices
    slices = values.groupBy(part.alias("part")).agg(F.sum("c").alias("pc"))
    offset = slices.select("part", (F.sum("pc").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("pc")).alias("before"))
    inside = Window.partitionBy("part").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("part", part).join(offset, "part").withColumn("upto", F.col("before") + F.sum("c").over(inside))
    return placed.filter(F.col("upto") > at).agg(F.min("w").alias("threshold"))


def cell_of(w: np.ndarray, cells: int) -> np.ndarray:
    """0 to ``cells`` - 1, not falling in w, of correlations."""
    at = w * (0.5 * (cells - 1))
    at += 0.5 * cells
    return at.astype(np.int64)


def values_of(tile: Tile) -> np.ndarray:
    return tile[2].ravel() if tile[3] is None else tile[2][tile[3]]


def edge_density_of(vectors: DataFrame, bins: int, digits: int | None = None, block: int = 2048, cells: int = 1 << 16) -> DataFrame:
    """``edge_density`` of the correlations of vectors: tasks give maxima, then histograms, never the pairs. Entries are
    counted by cells much smaller than bins; only those of cells that an edge of a bin may cross are binned one by one."""
    rounded = (lambda w: w) if digits is None else lambda w: np.round(w, digits)
    pairs = pairs_of(packed(vectors, block))

    def greatest(blocks: Iterator[tuple[Block, Block]]) -> Iterator[dict[str, np.ndarray]]:
        top, nn = 0.0, 0
        for a, b in blocks:
            for tile in tiles(a, b):
                w = values_of(tile)
                top, nn = max(top, w.max(initial=0.0), -w.min(initial=0.0)), nn + len(w)
        yield {"top": np.array([rounded(top)]), "nn": np.array([nn])}

    top, nn = of_pairs(pairs, greatest, "top double, nn long").agg(F.max("top"), F.sum("nn")).first()

    def bin_of(w: np.ndarray) -> np.ndarray:
        return np.minimum(bins - 1, np.floor(np.abs(rounded(w)) * bins / top if top else 0 * w).astype(int))

    def histogram(blocks: Iterator[tuple[Block, Block]]) -> Iterator[dict[str, np.ndarray]]:
        ends, room = (np.arange(cells + 1) - 0.5 * cells) / (0.5 * (cells - 1)), 1e-12 + (0 if digits is None else 10.0**-digits)
        of_cell, upper = bin_of(ends[:-1] - room), bin_of(ends[1:] + room)
        crossed = of_cell != upper
        by_cell, n = np.zeros(cells, np.int64), np.zeros(bins, np.int64)
        for a, b in blocks:
            for tile in tiles(a, b):
                w = values_of(tile)
                at = cell_of(w, cells)
                by_cell += np.bincount(at, minlength=cells)
                n += np.bincount(bin_of(w[crossed[at]]), minlength=bins)
        np.add.at(n, of_cell[~crossed], by_cell[~crossed])
        yield {"bin": np.flatnonzero(n), "n": n[n > 0]}

    counts = of_pairs(pairs, histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    grid = vectors.sparkSession.range(bins + 1).select(F.col("id").alias("bin")).join(counts, "bin", "left")  # one row per bin
    tail = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("bin", (F.col("bin") * F.lit(top) / bins).alias("threshold"), (tail / F.lit(nn)).alias("density"))


def threshold_of_density_of(vectors: DataFrame, rho: float, digits: int | None = None, diagonal: bool = True, block: int = 2048, bins: int = 1 << 16) -> DataFrame:
    """``threshold_of_density`` of the correlations of vectors: a histogram of all entries tells the cell of the order
    statistic; of that cell, entries are counted by value, once a second histogram has told the part of it, unless rounding
    leaves few values anyway. Rounding keeps the order, so entries are rounded only where they are counted by value."""
    n = usable(vectors).count()
    at, before = int((1 - rho) * (n * n - n)), 0
    own = n if diagonal else 0
    pairs = pairs_of(packed(vectors, block))
    chosen: list[int] = []

    def cells(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the entries within the chosen cells: (entries, their cells)."""
        if chosen:  # most lie elsewhere
            w = w[(w > (chosen[0] - 1 - 0.5 * bins) / (0.5 * (bins - 1))) & (w < (chosen[0] + 2 - 0.5 * bins) / (0.5 * (bins - 1)))]
        at = cell_of(w, bins)
        if not chosen:
            return w, at
        w = w[at == chosen[0]]
        at = np.clip(np.floor((w * (0.5 * (bins - 1)) + 0.5 * bins - chosen[0]) * bins), 0, bins - 1).astype(np.int64)
        return (w, at) if len(chosen) == 1 else (w[at == chosen[1]], at[at == chosen[1]])

    def histogram(blocks: Iterator[tuple[Block, Block]]) -> Iterator[dict[str, np.ndarray]]:
        n = np.zeros(bins, np.int64)
        for a, b in blocks:
            for tile in tiles(a, b):
                n += np.bincount(cells(values_of(tile))[1], minlength=bins)
        yield {"bin": np.flatnonzero(n), "n": n[n > 0]}

    def values(blocks: Iterator[tuple[Block, Block]]) -> Iterator[dict[str, np.ndarray]]:
        for a, b in blocks:
            for tile in tiles(a, b):
                w = cells(values_of(tile))[0]
                yield {"w": w if digits is None else np.round(w, digits)}

    def counted(blocks: Iterator[tuple[Block, Block]]) -> Iterator[dict[str, np.ndarray]]:
        for some in gathered(values(blocks)):
            w, c = np.unique(some["w"], return_counts=True)
            yield {"w": w, "c": 2 * c}

    for _ in range(1 if digits is not None and 2 * 10.0**digits <= float(bins) ** 2 else 2):
        total = np.zeros(bins, np.int64)
        for r in of_pairs(pairs, histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most ``bins`` rows
            total[r.bin] = 2 * r.n
        total += own * np.bincount(cells(np.ones(1))[1], minlength=bins)
        upto = before + np.cumsum(total)
        if upto[-1] <= at:
            return vectors.sparkSession.createDataFrame([], "threshold double")
        k = int(np.argmax(upto > at))
        before = int(upto[k] - total[k])
        chosen.append(k)
    rest = of_pairs(pairs, counted, "w double, c long")
    if len(cells(np.ones(1))[0]) and own:
        rest = rest.unionByName(vectors.sparkSession.createDataFrame([(1.0, own)], "w double, c long"))
    rest = rest.groupBy("w").agg(F.sum("c").alias("c"))
    order = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)  # a part of the value range with few values
    return rest.withColumn("upto", F.lit(before) + F.sum("c").over(order)).filter(F.col("upto") > at).agg(F.min("w").alias("threshold"))


def degree(mat: DataFrame, inward: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """(node, k): stored entries of each row or column; with ``nodes``, 0 for isolated ones."""
    got = mat.groupBy(F.col("j" if inward else "i").alias("node")).agg(F.count("*").alias("k"))
    return got if nodes is None else nodes.select("node").join(got, "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("k"))


def strength(mat: DataFrame, inward: bool = False, norm: bool = False) -> DataFrame:
    got = mat.groupBy(F.col("j" if inward else "i").alias("node")).agg(F.sum("w").alias("s"))
    return got if not norm else got.crossJoin(F.broadcast(mat.agg(F.sum("w").alias("ss")))).select("node", ratio("s", "ss").alias("s"))


def area_weighted_connectivity(mat: DataFrame, places: DataFrame) -> DataFrame:
    """degree cos(lat) / sum of cos(lat) over all places (node, lat)."""
    area = places.agg(F.sum(F.cos(F.radians("lat"))).alias("area"))
    return degree(mat, nodes=places).join(places, "node").crossJoin(F.broadcast(area)).select("node", (F.col("k") * F.cos(F.radians("lat")) / F.col("area")).alias("c"))


def cross_degree(mat: DataFrame, n: int) -> DataFrame:
    """(node, out_weight, in_weight): between the layers 0..n/2-1 and n/2..n-1, seen from the first."""
    half = n // 2
    out = mat.filter((F.col("i") < half) & (F.col("j") >= half)).select(F.col("i").alias("node"), F.col("w").alias("a"), F.lit(0.0).alias("b"))
    back = mat.filter((F.col("i") >= half) & (F.col("j") < half)).select(F.col("j").alias("node"), F.lit(0.0).alias("a"), F.col("w").alias("b"))
    return out.unionByName(back).groupBy("node").agg(F.sum("a").alias("out_weight"), F.sum("b").alias("in_weight"))


def place_pairs(places: DataFrame) -> DataFrame:
    """(i, j, lon1, lat1, lon2, lat2) for i < j; the places are a small table of coordinates."""
    a = places.select(F.col("node").alias("i"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = places.select(F.col("node").alias("j"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(b, F.col("i") < F.col("j"))


def zonal_angles(places: DataFrame) -> DataFrame:
    """(i, j, angle) both ways with the same angle, atan2 of the latitude and longitude differences."""
    half = place_pairs(places).select("i", "j", F.atan2(F.col("lat2") - F.col("lat1"), F.col("lon2") - F.col("lon1")).alias("angle"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "angle"))


def distances(places: DataFrame, arc: bool = True) -> DataFrame:
    d = (great_circle if arc else planar_degrees)("lon1", "lat1", "lon2", "lat2")
    return place_pairs(places).select("i", "j", d.alias("d"))


def projected_degree(mat: DataFrame, angles: DataFrame) -> DataFrame:
    """(node, x, y): per column, sums of |w cos(angle)| and |w sin(angle)|."""
    return mat.join(angles, ["i", "j"]).groupBy(F.col("j").alias("node")).agg(F.sum(F.abs(F.col("w") * F.cos("angle"))).alias("x"), F.sum(F.abs(F.col("w") * F.sin("angle"))).alias("y"))


def gradient_similarity(values: DataFrame, dist: DataFrame, precision: float = 1.0) -> DataFrame:
    """round(precision |f_j - f_i| / d_ij), left scaled."""
    a, b = values.select(F.col("node").alias("i"), F.col("value").alias("fi")), values.select(F.col("node").alias("j"), F.col("value").alias("fj"))
    return dist.join(a, "i").join(b, "j").select("i", "j", F.round(ratio(F.lit(precision) * F.abs(F.col("fj") - F.col("fi")), "d")).alias("w"))


def flow_adjacency(velocity: DataFrame, dist: DataFrame, loc: float) -> DataFrame:
    """Links where the distance is at most sqrt(loc / pi) (u^2 + v^2)^(1/4) of the source (node, u, v)."""
    reach = F.lit(math.sqrt(loc / math.pi)) * F.pow(F.col("u") * F.col("u") + F.col("v") * F.col("v"), F.lit(0.25))
    both = dist.unionByName(dist.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.join(velocity.select(F.col("node").alias("i"), reach.alias("reach")), "i").filter("d <= reach").select("i", "j")


def self_loop_score(mat: DataFrame, n: int) -> DataFrame:
    """(trace - 1) / n."""
    return mat.agg(((F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("w"))), F.lit(0.0)) - 1) / n).alias("q"))


def modularity(mat: DataFrame, members: DataFrame) -> DataFrame:
    """Newman's directed modularity of a partition."""
    from tidelens.operators.markov import community_flow

    flow, total = community_flow(mat, members), mat.agg(F.sum("w").alias("ww"))
    ends = flow.select(F.col("i").alias("com"), F.col("w").alias("o"), F.lit(0.0).alias("k"), F.when(F.col("i") == F.col("j"), F.col("w")).otherwise(0.0).alias("own")).unionByName(flow.select(F.col("j").alias("com"), F.lit(0.0).alias("o"), F.col("w").alias("k"), F.lit(0.0).alias("own")))
    by = ends.groupBy("com").agg(F.sum("o").alias("o"), F.sum("k").alias("k"), F.sum("own").alias("own"))
    return by.crossJoin(F.broadcast(total)).agg(F.sum(F.col("own") / F.col("ww") - F.col("o") * F.col("k") / (F.col("ww") * F.col("ww"))).alias("q"))


def distance_blocks(mat: DataFrame, nodes: DataFrame, sources: DataFrame | None = None, most_rounds: int | None = None, delta: float | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(places, state, size of a block): (node, block, slot) of each source, and (block, node, d), the least sums of weights along directed
    paths to the node from the sources of a block, by slot; infinite where there is no path.

    Delta-stepping: the state of a node is one row for a block of sources. A round relaxes only entries that are new and
    within the current step of ``delta`` (by default the greatest weight); once there are none, the step moves on to the
    least new entry. So rounds follow the greatest distance over delta and the edges of a step's paths. Negative weights take
    all new entries each round, and more rounds than nodes (a cycle of negative weight) are an error, as are more than
    ``most_rounds``. ``block`` sources, by default up to 32, share a row.
    """
    edges = cut_lineage(mat.filter("i <> j").groupBy(F.col("i").alias("node"), F.col("j").alias("to")).agg(F.min("w").alias("w")))
    known = edges.agg(F.min("w").alias("low"), F.max("w").alias("high")).first()
    negative = known.low is not None and known.low < 0
    delta = math.inf if negative or known.high is None or not known.high > 0 else delta or float(known.high)
    n = nodes.count()
    limit = most_rounds if most_rounds is not None else n + 1 if negative else None
    block = block or min(32, max(4, n // (4 * nodes.sparkSession.sparkContext.defaultParallelism)))
    start = (nodes if sources is None else nodes.join(sources.select("node").distinct(), "node", "left_semi")).select("node")
    places = ordering.placed(start, "node").select("node", F.floor(F.col("place") / block).alias("block"), (F.col("place") % block).cast("int").alias("slot"))
    slots, none = range(block), F.lit(math.inf)
    first = F.array(*[F.when(F.col("slot") == k, 0.0).otherwise(none) for k in slots])
    state = table = cut_lineage(places.groupBy("block", "node").agg(F.min("slot").alias("slot")).select("block", "node", first.alias("d"), first.alias("fresh")))
    bound, rounds = delta, 0
    while True:
        least = state.agg(F.min(F.array_min("fresh"))).first()[0]
        if least is None or least == math.inf:
            return places, state.select("block", "node", "d"), block
        if limit is not None and rounds > limit:
            raise RuntimeError(f"paths still shorten after {limit} rounds")
        rounds += 1
        bound = bound if least <= bound else least + delta
        due = lambda x: x <= F.lit(float(bound))
        going = state.filter(F.exists("fresh", lambda x: due(x) & (x < none))).select("block", "node", F.transform("fresh", lambda x: F.when(due(x), x).otherwise(none)).alias("x"))
        reached = going.join(edges, "node").groupBy("block", F.col("to").alias("node")).agg(*[F.min(F.get("x", F.lit(k)) + F.col("w")).alias(f"x{k}") for k in slots])
        reached = reached.select("block", "node", F.array(*[f"x{k}" for k in slots]).alias("x"))
        empty = F.array(*[none] * block)
        both = state.join(reached, ["block", "node"], "full").select("block", "node", F.coalesce("d", empty).alias("d"), F.coalesce("fresh", empty).alias("fresh"), F.coalesce("x", empty).alias("x"))
        waiting = F.transform("fresh", lambda x: F.when(due(x), none).otherwise(x))
        both = both.select("block", "node", "d", waiting.alias("waiting"), F.zip_with("x", "d", lambda x, d: F.when(x < d, x).otherwise(none)).alias("shorter"))
        state = cut_lineage(both.select("block", "node", F.zip_with("d", "shorter", lambda a, b: F.least(a, b)).alias("d"), F.zip_with("waiting", "shorter", lambda a, b: F.least(a, b)).alias("fresh")), instead_of=table)
        table = state


def shortest_paths(mat: DataFrame, nodes: DataFrame, sources: DataFrame | None = None, most_rounds: int | None = None, **how) -> DataFrame:
    """(i, j, d): least sums of weights along directed paths from all nodes, or from ``sources`` (node)."""
    places, state, _ = distance_blocks(mat, nodes, sources, most_rounds, **how)
    far = state.select("block", F.col("node").alias("j"), F.posexplode("d").alias("slot", "d")).filter(F.col("d") < math.inf)
    return far.join(places.withColumnRenamed("node", "i"), ["block", "slot"]).select("i", "j", "d")


def closeness(mat: DataFrame, nodes: DataFrame, **how) -> DataFrame:
    """(node, c): 1 / mean distance to all N nodes, itself (0) included, unreachable ones at distance N; of all nodes, or
    of ``sources``."""
    n = nodes.count()
    places, state, block = distance_blocks(mat, nodes, **how)
    far = [F.get("d", F.lit(k)) for k in range(block)]
    sums = state.groupBy("block").agg(*[F.sum(F.when(x < math.inf, x).otherwise(0.0)).alias(f"s{k}") for k, x in enumerate(far)], *[F.count_if(x < math.inf).alias(f"n{k}") for k, x in enumerate(far)])
    of_slot = sums.select("block", F.posexplode(F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.col(f"n{k}").alias("k")) for k in range(block)])).alias("slot", "x"))
    return places.join(of_slot, ["block", "slot"]).select("node", ratio(F.lit(float(n)), F.col("x.s") + (n - F.col("x.k")) * n).alias("c"))


def core_numbers(links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, core): the greatest k for which a node lies in a subgraph of inner degrees of k or more. ``links`` has (i, j),
    each both ways once. From the degree on, a node's number is the greatest h with h neighbours of h or more, until
    nothing changes; neighbours are counted by their number before they meet, so no node's neighbours are in one place."""
    got = table = cut_lineage(links.groupBy(F.col("i").alias("node")).agg(F.count("*").alias("core")))
    for _ in range(most_rounds):
        counted = links.join(got.select(F.col("node").alias("j"), F.col("core").alias("h")), "j").groupBy("i", "h").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("i").orderBy(F.desc("h")))
        index = counted.withColumn("x", F.least("h", above)).groupBy(F.col("i").alias("node")).agg(F.max("x").alias("new"))
        new = cut_lineage(got.select("node", "core").join(index, "node").select("node", F.col("new").alias("core"), (F.col("new") < F.col("core")).alias("moved")), instead_of=table)
        got = table = new
        if new.filter("moved").isEmpty():
            return new.select("node", "core")
    raise RuntimeError(f"core numbers did not settle in {most_rounds} rounds")


def peeled(mat: DataFrame, members: DataFrame, least_density: float) -> DataFrame:
    """(node, com): in each community, the node of least inner degree is dropped while that is below
    least_density (size - 1); ties go to the smaller id.

    Whatever the ties, dropping so passes through every k-core. As long as k is below least_density times the size of the
    next core, the end can't fall between the two, so such shells are dropped at once, by core numbers. Of what remains,
    communities that are dense enough are done; only in the others is a last core peeled node by node, a core a task.
    """
    members = members.select("node", "com").distinct()
    ci, cj = members.select(F.col("node").alias("i"), "com"), members.select(F.col("node").alias("j"), F.col("com").alias("cj"))
    inner = mat.filter("i <> j").join(ci, "i").join(cj, "j").filter("com = cj").select("com", "i", "j")
    links = cut_lineage(inner.unionByName(inner.select("com", F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    cores = cut_lineage(members.join(core_numbers(links.select("i", "j")), "node", "left").select("com", "node", F.coalesce("core", F.lit(0)).cast("long").alias("core")))
    shells = cores.groupBy("com", "core").agg(F.count("*").alias("n"))
    down = Window.partitionBy("com").orderBy(F.desc("core"))
    sizes = shells.withColumn("size", F.sum("n").over(down)).withColumn("next", F.coalesce(F.lag("size").over(down), F.lit(0)))
    last = sizes.filter(F.col("core") >= F.lit(float(least_density)) * F.col("next")).groupBy("com").agg(F.min("core").alias("last"), F.max("size").alias("size"))
    done = F.col("last") >= F.lit(float(least_density)) * (F.col("size") - 1)
    left = cut_lineage(cores.join(last.withColumn("done", done), "com").filter("core >= last").select("com", "node", "done"))
    open_nodes = left.filter("not done").select("com", F.col("node").alias("i"))
    ends = links.join(open_nodes, ["com", "i"], "left_semi").join(open_nodes.withColumnRenamed("i", "j"), ["com", "j"], "left_semi").filter("i < j")
    rows = ends.select("com", "i", "j").unionByName(open_nodes.withColumn("j", F.lit(None).cast("long")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        com = pdf["com"].iloc[0]
        near: dict[int, set[int]] = {int(x): set() for x in pdf["i"]}
        for a, b in pdf[pdf["j"].notna()][["i", "j"]].itertuples(index=False):
            near[int(a)].add(int(b))
            near[int(b)].add(int(a))
        queue = [(len(n), v) for v, n in near.items()]
        heapq.heapify(queue)
        while near:
            degree, node = heapq.heappop(queue)
            if node not in near or degree != len(near[node]):
                continue  # an entry of before its neighbour went
            if degree >= least_density * (len(near) - 1):
                break
            for v in near.pop(node):
                near[v].discard(node)
                heapq.heappush(queue, (len(near[v]), v))
        return pd.DataFrame({"node": sorted(near), "com": com})

    return left.filter("done").select("node", "com").unionByName(rows.groupBy("com").applyInPandas(run, "node long, com long"))


def community_peel_filter(mat: DataFrame, members: DataFrame, least_density: float, least_size: int) -> DataFrame:
    """Peeled communities of at least ``least_size`` nodes, renumbered 1, 2, ...; all other nodes 0."""
    kept = peeled(mat, members.filter("com > 0"), least_density)
    large = kept.groupBy("com").agg(F.count("*").alias("n")).filter(F.col("n") >= least_size).select("com")
    low = large.select(F.col("com").alias("low"))
    label = large.join(low, F.col("low") <= F.col("com")).groupBy("com").agg(F.count("*").alias("label"))
    named = kept.join(label, "com").select("node", "label")
    return members.select("node").join(named, "node", "left").select("node", F.coalesce("label", F.lit(0)).cast("long").alias("com"))


