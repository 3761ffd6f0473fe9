"""N-gram Jaccard join with a count-vector R-tree.

Documents link when their sets of distinct word shingles have a Jaccard similarity of at least num / den. Equal sets
form one class, named by a 64-bit hash of set and size. A class is a point: its shingles are hashed into groups and counted. The sum over groups of the lesser
counts bounds the overlap of two classes from above; an R-tree over the points, whose boxes give the same bound for all
points below, finds the pairs that may overlap enough, and the sets of the surviving pairs are compared.

What brings points together in one tree: linked sets must share one of their first n - ceil(num * n / den) + 1 shingles
in any common order (prefix filter, exact). The order puts shingles that are frequent over the whole corpus last (counts
of all shingles in a fixed number of hash buckets), so cells, the classes that share such a shingle, stay small even
where passages are shared by many documents. Cells with the same members are one. A cell of more than ``block`` points
is dealt into pairs of blocks, each a task of bounded size.

A point has about a group for each shingle (a power of two of groups, 128 at least), since few groups tell long
texts apart no more. The tree works on the counts folded to 128; pairs that it leaves pass the bound on the finer ones.

Joining is done twice. The first pass compares the points of a cell with the first one, those left with the first of
them, and so on for ``leaders`` turns, each leader also with a few points of the earlier ones, which is enough for the
components of large groups of near copies without comparing all pairs. The second pass searches, in cells that still span several components, for all points outside the
largest one; so no link that joins components is missed.

Defined cases: null text or a text without words has an empty set and links with nothing; a text of fewer words than
a shingle has one shingle, its whole sequence; repeated rows and copies link with each other; rows that repeat an id
with other texts are one document to ``join`` (what either links with is one component) and separate texts to
``keep_one``, which loses none of them; rows without an id take no part; texts of any length are read whole; empty
tables give no rows; columns other than id and text are ignored by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import storage

from .common import lean, materialise, slices, table, text_bytes
from .components import components
from .shingles import Shingler, mixed


@dataclass(frozen=True)
class Settings:
    words: int = 5
    num: int = 3
    den: int = 4
    groups: int = 128
    buckets_log2: int = 22
    block: int = 8192
    leaf: int = 32
    per_group: int = 1
    leaders: int = 16
    ties: int = 4
    bitmap_log2: int = 27

    def enough(self, overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """overlap / (sizes - overlap) >= num / den, sizes being the sum of both."""
        return (self.num + self.den) * overlap >= self.num * sizes


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def class_name(s: np.ndarray) -> int:
    """64 bits of a set of hashes, whatever its order, and of its size."""
    total = mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(mixed(np.array([total], np.uint64) + np.array([len(s)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0])


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text, doc_id); ``row`` names the pair of id and text."""
    return docs.select(row_name(id_col, text_col).alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def row_name(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def sets(batch: pa.RecordBatch, shingler: Shingler) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row offset, shingle sets) of slices of bounded bytes of a batch (row, text, ...)."""
    data, starts, ends = text_bytes(batch.column(1))
    for a, b in slices(starts, ends, 1 << 18):
        yield a, shingler(data, starts[a:b], ends[a:b])


def packed_counts(counts: np.ndarray) -> bytes:
    """Bytes, or the places and values of those that are not 0 where that is shorter."""
    at = np.flatnonzero(counts)
    return b"d" + counts.tobytes() if 5 * len(at) >= len(counts) else b"s" + at.astype("<u4").tobytes() + counts[at].tobytes()


def add_counts(total: np.ndarray, packed: bytes) -> None:
    if packed[:1] == b"d":
        total += np.frombuffer(packed, np.uint8, offset=1)
    else:
        n = (len(packed) - 1) // 5
        total[np.frombuffer(packed, "<u4", n, 1)] += np.frombuffer(packed, np.uint8, n, 1 + 4 * n)


PARTS = 256  # of the table of bucket counts; a task adds up few of them, however many tasks counted


def measured(docs: DataFrame, how: Settings) -> DataFrame:
    """First pass: (doc_id, row, n, id) of each document, and rows (part, counts) of a task's shingle counts by hash
    bucket, each count at most 255."""
    shift = np.uint64(64 - how.buckets_log2)
    names = ["doc_id", "row", "n", "id", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(how.words), np.zeros(1 << how.buckets_log2, np.uint8)
        waiting: list[np.ndarray] = []

        def count() -> None:
            if waiting:
                at, more = np.unique(np.concatenate(waiting), return_counts=True)
                counts[at] = np.minimum(counts[at] + more, 255)
                waiting.clear()

        for batch in batches:
            n, own_names = [], []
            for _, own in sets(batch, shingler):
                n += [len(s) for s in own]
                own_names += [class_name(s) for s in own]
                waiting += [(s >> shift).astype(np.uint32) for s in own]
                if sum(map(len, waiting)) > 500_000:
                    count()
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(n, pa.int64()), pa.array(own_names, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        count()
        if counts.any():
            packed = [packed_counts(c) for c in np.split(counts, PARTS)]
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.mapInArrow(lean(run), "doc_id long, row long, n long, id long, part int, counts binary")


def frequency_ranks(rows: DataFrame, how: Settings) -> np.ndarray:
    """For each hash bucket a byte that grows with its count: 64 steps up to the mean, and up to twice the mean, then 16
    for each doubling. The table has a fixed size; with more text it only tells frequent shingles less well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column(0)[k].as_py()
                if part not in total:
                    total[part] = np.zeros((1 << how.buckets_log2) // PARTS, np.uint32)
                add_counts(total[part], batch.column(1)[k].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["part", "counts"])

    got = rows.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(lean(run), "part int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(bytes(r.counts), np.uint32) for r in sorted(got, key=lambda r: r.part)]) if got else np.zeros(1 << how.buckets_log2, np.uint32)
    ratio = counts / np.float32(max(1.0, float(counts.mean())))
    return np.minimum(255, np.where(ratio < 2, 64 * ratio, 128 + 16 * np.log2(np.maximum(ratio, 2) / 2))).astype(np.uint8)


def prefixes(docs: DataFrame, frequent: np.ndarray, how: Settings) -> DataFrame:
    """Second pass: (token, id, n, pos) for the prefix of each class; a task gives a class that it meets again once."""
    shift = np.uint64(64 - how.buckets_log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(how.words), set()
        for batch in batches:
            for _, own in sets(batch, shingler):
                tokens, names, sizes, places = [], [], [], []
                for s in own:
                    name = class_name(s)
                    if not len(s) or name in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    keep = len(s) - -(-how.num * len(s) // how.den) + 1
                    rank = frequent[(s >> shift).astype(np.int64)]
                    tokens.append(s[np.argsort(rank, kind="stable")[:keep]])
                    names.append(np.full(keep, name))
                    sizes.append(np.full(keep, len(s)))
                    places.append(np.arange(keep))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(tokens))), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "id", "n", "pos"])

    return docs.mapInArrow(lean(run), "token long, id long, n long, pos long")


def possible(token: np.ndarray, n: np.ndarray, pos: np.ndarray, how: Settings) -> np.ndarray:
    """Which rows (in order of token and n) may link with another one of their token.

    A row needs a neighbour in size within the ratio. Where a token has two rows only and is their first common one, at
    most the shingles from there on are common; if it is not the first, the first one's cell holds the pair.
    """
    if not len(token):
        return np.zeros(0, bool)
    pair = (token[1:] == token[:-1]) & (how.den * n[:-1] >= how.num * n[1:])
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    two = first[np.diff(np.r_[first, len(token)]) == 2]
    left = np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1])
    pair[two] &= how.enough(left, n[two] + n[two + 1])
    return np.r_[pair, False] | np.r_[False, pair]


def shared_cells(tokens: DataFrame, how: Settings) -> DataFrame:
    """(cell, id) of cells with two members at least, and for each cell a row with ``sig``, the hash of its members.

    A task reads its tokens in order and holds one run at a time; a run longer than ``long_run`` goes out in parts, all
    of its rows, under a signature that no other cell has.
    """
    long_run = 1 << 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        parted = None  # the token of a long run whose first rows went out

        def packed(cell, ids, sig) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cell, ids, sig)], names=["cell", "id", "sig"])

        def emit(token, ids, n, pos) -> Iterator[pa.RecordBatch]:
            keep = possible(token, n, pos, how) | (token == parted if parted is not None else False)
            token, ids = token[keep], ids[keep]
            if not len(token):
                return
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[first, len(token)])
            sig = as_long(np.add.reduceat(mixed(ids.view(np.uint64)), first))
            if parted is not None and token[0] == parted:
                sig[0] = as_long(mixed(token[:1].view(np.uint64) ^ np.uint64(0x5A5A5A5A5A5A5A5A)))[0]
            new = np.zeros(len(first), bool)
            for k, own in enumerate(sig.tolist()):
                if own not in seen:
                    new[k] = True
                    if len(seen) < 1_000_000:
                        seen.add(own)
            if new.any():
                at = np.repeat(new, size)
                yield packed(token[at], ids[at], pa.nulls(int(at.sum()), pa.int64()))
                yield packed(token[first[new]], pa.nulls(int(new.sum()), pa.int64()), sig[new])

        for batch in batches:
            token, ids, n, pos = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in zip((0, 1, 2, 3), held, strict=True))
            fresh = np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])] if len(token) else np.zeros(0, bool)
            token, ids, n, pos = token[fresh], ids[fresh], n[fresh], pos[fresh]
            cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
            yield from emit(token[:cut], ids[:cut], n[:cut], pos[:cut])
            held = [token[cut:], ids[cut:], n[cut:], pos[cut:]]
            if cut:
                parted = None
            if len(held[0]) > long_run:
                parted = int(held[0][0])
                yield packed(held[0][:-1], held[1][:-1], pa.nulls(len(held[0]) - 1, pa.int64()))
                held = [h[-1:] for h in held]
        yield from emit(*held)

    return tokens.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(lean(run), "cell long, id long, sig long")


def count_vector(s: np.ndarray, how: Settings) -> bytes:
    """Counts by the low bits of the hashes; the first byte is the width of a count: half a byte (0), or 4 bytes."""
    size = how.groups
    while size * how.per_group < len(s):
        size *= 2
    counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    if counts.max(initial=0) < 16:
        small = counts.astype(np.uint8)
        return b"\0" + (small[0::2] | (small[1::2] << 4)).tobytes()
    return b"\4" + counts.astype("<u4").tobytes()


def counts_of(packed: bytes) -> np.ndarray:
    if packed[0]:
        return np.frombuffer(packed, "<u4", offset=1).astype(np.int32)
    raw = np.frombuffer(packed, np.uint8, offset=1)
    out = np.empty(2 * len(raw), np.int32)
    out[0::2], out[1::2] = raw & 15, raw >> 4
    return out


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts over fewer groups, again by the low bits."""
    return counts if len(counts) == size else counts.reshape(-1, size).sum(axis=0)


def described(docs: DataFrame, needed: DataFrame, how: Settings, name: str, of_set: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, n, <name>) of the classes of the rows in ``needed`` (row), and of a few more: a further pass over the texts.

    The tasks know the needed rows by a bitmap, which is sized by their number (eight bits for each, at most 2^bitmap_log2
    bits) and put together in parts; a row that only looks needed does no harm. Beyond that size the rows are joined.
    """
    bits_log2 = max(16, int(8 * max(1, needed.count()) - 1).bit_length())
    if bits_log2 > how.bitmap_log2:
        rows, packed = docs.join(needed.distinct(), "row", "left_semi").select(*docs.columns), None
    else:
        rows, packed = docs, docs.sparkSession.sparkContext.broadcast(bitmap(needed, bits_log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(how.words), set()
        wanted = None if packed is None else np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted[slot_of(batch.column(0).to_numpy(), bits_log2)]))
            for _, own in sets(batch, shingler):
                if len(seen) > 200_000:
                    seen.clear()
                got = {}
                for s in own:
                    own_name = class_name(s)
                    if own_name not in seen:
                        seen.add(own_name)
                        got[own_name] = s
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([len(s) for s in got.values()], pa.int64()), pa.array([of_set(s) for s in got.values()], pa.binary())], names=["id", "n", name])

    return rows.mapInArrow(lean(run), f"id long, n long, {name} binary")


def slot_of(rows: np.ndarray, bits_log2: int) -> np.ndarray:
    return (mixed(rows.view(np.uint64)) >> np.uint64(64 - bits_log2)).astype(np.int64)


def bitmap(needed: DataFrame, bits_log2: int, parts_log2: int = 8) -> np.ndarray:
    """Packed bits of the slots of all rows in ``needed``; each part is put together by one task."""
    inside = bits_log2 - parts_log2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(slot_of(batch.column(0).to_numpy(), bits_log2))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> inside).astype(np.int32)), pa.array((slot & ((1 << inside) - 1)).astype(np.int32))], names=["part", "slot"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            part, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part).tolist():
                bits.setdefault(p, np.zeros(1 << inside, bool))[slot[part == p]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([np.packbits(b).tobytes() for b in bits.values()], pa.binary())], names=["part", "bits"])

    got = needed.select("row").mapInArrow(slots, "part int, slot int").repartition("part").mapInArrow(packed, "part int, bits binary").collect()
    out = np.zeros((1 << parts_log2, (1 << inside) // 8), np.uint8)
    for r in got:
        out[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


class CountTree:
    """R-tree, packed bottom-up: points in order of size and, within a slab, of their most spread coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, how: Settings, fan: int = 8):
        self.how, leaf = how, how.leaf
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), leaf * fan):
            slab = order[a : a + leaf * fan]
            order[a : a + leaf * fan] = slab[np.argsort(points[slab, points[slab].var(axis=0).argmax()], kind="stable")]
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        starts = np.arange(0, len(order), leaf)
        self.levels = [(np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts))]
        while len(self.levels[-1][0]) > 1:
            top, low, high = self.levels[-1]
            starts = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
        self.fan = fan

    def fits(self, q: np.ndarray, n: np.ndarray, top: np.ndarray, low: int, high: int) -> np.ndarray:
        """Which queries may overlap enough with some point in a box whose greatest counts are ``top``."""
        h = self.how
        sized = (h.den * n >= h.num * low) & (h.den * high >= h.num * n)
        return sized & h.enough(np.minimum(q, top).sum(axis=1), n + np.maximum(low, -(-h.num * n // h.den)))

    def search(self, q: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, point positions) that pass the bound, leaf by leaf."""
        stack = [(len(self.levels) - 1, 0, np.arange(len(q)))]
        while stack:
            level, k, own = stack.pop()
            top, low, high = (x[k] for x in self.levels[level])
            own = own[self.fits(q[own], n[own], top, low, high)]
            if not len(own):
                continue
            if level:
                stack += [(level - 1, c, own) for c in range(k * self.fan, min((k + 1) * self.fan, len(self.levels[level - 1][0])))]
                continue
            at = np.arange(k * self.how.leaf, min((k + 1) * self.how.leaf, len(self.points)))
            for a in range(0, len(own), 512):
                part = own[a : a + 512]
                overlap = np.minimum(q[part][:, None], self.points[at][None]).sum(axis=2)
                x, y = np.nonzero(self.how.enough(overlap, n[part][:, None] + self.sizes[at][None]))
                yield part[x], self.order[at[y]]


def may_link(x: np.ndarray, y: np.ndarray, sizes: int, how: Settings) -> bool:
    size = min(len(x), len(y))
    return bool(how.enough(np.minimum(folded(x, size), folded(y, size)).sum(), sizes))


def star_pairs(ids: np.ndarray, n: np.ndarray, fine: list[np.ndarray], how: Settings) -> list[tuple[int, int]]:
    """Pairs of a leader with all that it may link with, then of a leader among those that are left, and so on; and of
    each leader with the ``ties`` points of every earlier star that it overlaps most, so that stars join.

    The leader is the point that overlaps most, for its size, with the mean of those that are left, so that it lies
    amid the largest group of near copies (ties: the least name)."""
    counts, star, found = np.stack([folded(c, how.groups) for c in fine]), np.full(len(ids), -1), []
    order = np.argsort(ids)
    for turn in range(how.leaders):
        left = order[star[order] < 0]
        if not len(left) or len(left) == 1 and not turn:
            break
        mean = counts[left].mean(axis=0)
        common = np.minimum(counts[left], mean).sum(axis=1)
        a = left[np.argmax(common / (n[left] + mean.sum() - common))]
        star[a] = turn
        overlap = np.minimum(counts[a], counts).sum(axis=1)
        near = (how.den * np.minimum(n[a], n) >= how.num * np.maximum(n[a], n)) & how.enough(overlap, n[a] + n)
        near[a] = False
        for b in np.flatnonzero(near & (star < 0)).tolist():
            if may_link(fine[a], fine[b], int(n[a] + n[b]), how):
                star[b] = turn
                found.append((int(ids[a]), int(ids[b])))
        close = np.flatnonzero(near & (star >= 0) & (star < turn))
        close = close[np.lexsort((ids[close], -overlap[close] / (n[a] + n[close])))]
        ties = np.zeros(how.leaders, np.int64)
        for b in close.tolist():
            if ties[star[b]] < how.ties and may_link(fine[a], fine[b], int(n[a] + n[b]), how):
                ties[star[b]] += 1
                found.append((min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b]))))
    return found


def tree_pairs(ids: np.ndarray, n: np.ndarray, fine: list[np.ndarray], label: np.ndarray, how: Settings) -> Iterator[tuple[int, int]]:
    """All pairs of points with different labels that may link, each once."""
    counts = np.stack([folded(c, how.groups) for c in fine])
    names, size = np.unique(label, return_counts=True)
    asks = label != names[size.argmax()]  # of two labels one is not the largest
    asking = np.flatnonzero(asks)
    for x, y in CountTree(counts, n, how).search(counts[asking], n[asking]):
        x = asking[x]
        across = (label[x] != label[y]) & (~asks[y] | (x < y))
        for a, b in zip(x[across].tolist(), y[across].tolist(), strict=True):
            if may_link(fine[a], fine[b], int(n[a] + n[b]), how):
                yield int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))


def cell_pairs(cell_points: DataFrame, large: DataFrame | None, how: Settings, stars: bool) -> DataFrame:
    """Distinct pairs a < b within cells (cell, id, n, counts, label) that pass the bound; ``large``: (cell, blocks) of
    the cells that are dealt into blocks."""
    if large is None:
        rows = cell_points.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "id", "n", "counts", "label")
    else:
        rows = cell_points.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "counts", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: set[tuple[int, int]] = set()

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, n, label = (rows.column(c).to_numpy() for c in ("id", "n", "label"))
            _, keep = np.unique(ids, return_index=True)
            packed = rows.column("counts")
            fine = [counts_of(packed[k].as_py()) for k in keep.tolist()]
            if len(keep) > 1:
                for pair in star_pairs(ids[keep], n[keep], fine, how) if stars else tree_pairs(ids[keep], n[keep], fine, label[keep], how):
                    found.add(pair)
                    if len(found) > 200_000:
                        yield out()

        def out() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, i, j = (batch.column(c).to_numpy() for c in ("cell", "i", "j"))
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            ends = np.r_[first[1:], batch.num_rows]
            for s, e in zip(first.tolist(), ends.tolist(), strict=True):
                part = batch.slice(s, e - s)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in ("cell", "i", "j")):
                    yield from done(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from done(pa.Table.from_batches(held))
        yield out()

    keys = ["cell", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a long, b long").distinct()


def verified(pairs: DataFrame, all_points: DataFrame, how: Settings) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough: a's set meets those of its partners in one streamed group."""
    salts = 64  # a point with many partners is compared in several tasks
    own = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    right = own.join(all_points.select(F.col("id").alias("b"), "hashes"), "b").select("a", "salt", "b", "hashes")
    left = own.select("a", "salt").distinct().join(all_points.select(F.col("id").alias("a"), "hashes"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            a_s, b_s = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (a, b) in enumerate(zip(a_s, b_s, strict=True)):
                hashes = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64)
                if b is None:
                    at, mine = a, hashes.copy()
                elif a == at:
                    slots = np.searchsorted(mine, hashes)
                    overlap = int((mine[np.minimum(slots, len(mine) - 1)] == hashes).sum())
                    if how.enough(overlap, len(mine) + len(hashes)):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    both = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.select("a", "b", "hashes").mapInArrow(lean(run), "a long, b long").distinct()


def linked_classes(rows: DataFrame, how: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of ``named`` rows: members (doc_id, row, n, id), classes (id, low: least doc_id and row), links (a, b) between
    classes, enough for their components, and these components (node, label)."""
    with storage.scratch(rows.sparkSession) as keep:
        return linked_within(rows, how, keep)


def linked_within(rows: DataFrame, how: Settings, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``linked_classes``, where only tables given to ``keep`` last; the larger ones go as soon as they are used."""
    spark = rows.sparkSession
    first = keep(materialise(measured(rows, how), "ngram-measured"))
    members = first.filter("part is null").select("doc_id", "row", "n", "id")
    classes = keep(materialise(members.filter("n > 0 and doc_id is not null").groupBy("id").agg(F.min(F.struct("doc_id", "row")).alias("low")), "ngram-classes"))
    rows = rows.filter("doc_id is not null")
    cells = materialise(shared_cells(prefixes(rows, frequency_ranks(first, how), how), how), "ngram-cells")
    kept = cells.filter("sig is not null").groupBy("sig").agg(F.min("cell").alias("cell")).select("cell").distinct()
    placed = materialise(cells.filter("sig is null").join(kept, "cell", "left_semi").select("cell", "id"), "ngram-placed")

    storage.delete(spark, cells.written_to)

    def of_classes(ids: DataFrame, name: str, of_set: Callable[[np.ndarray], bytes]) -> DataFrame:
        needed = materialise(classes.join(ids.distinct(), "id", "left_semi").select(F.col("low.row").alias("row")), "ngram-needed")
        got = materialise(described(rows, needed, how, name, of_set), f"ngram-{name}")
        storage.delete(spark, needed.written_to)
        return got

    known = of_classes(placed.select("id"), "counts", lambda s: count_vector(s, how))
    large = materialise(placed.groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > how.block).select("cell", F.ceil(F.col("m") / how.block).cast("int").alias("blocks")), "ngram-large")
    large = None if large.isEmpty() else large

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets overlap enough."""
        with storage.scratch(spark) as keep_links:
            pairs = materialise(pairs, "ngram-pairs")
            hashes = of_classes(pairs.select(F.explode(F.array("a", "b")).alias("id")), "hashes", lambda s: s.tobytes())
            return keep(keep_links(materialise(verified(pairs, hashes, how), "ngram-links")))

    links = linked(cell_pairs(placed.join(known, "id").withColumn("label", F.col("id")), large, how, True))
    labels = materialise(components(links), "ngram-labels")
    marked = placed.join(labels, placed.id == labels.node, "left").select("cell", "id", F.coalesce("label", "id").alias("label"))
    open_cells = marked.groupBy("cell").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("cell")
    more = linked(cell_pairs(marked.join(open_cells, "cell", "left_semi").join(known, "id"), large, how, False))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = materialise(components(links), "ngram-labels")
    return members, classes, links, keep(labels)


def of_components(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, component, low): the component of each class, named by one of its classes."""
    return classes.join(labels, classes.id == labels.node, "left").select("id", F.coalesce("label", "id").alias("component"), "low")


def join(docs: DataFrame, how: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id that links lead to)."""
    members, classes, links, labels = linked_classes(named(docs, id_col, text_col), how)
    of_id = members.filter("n > 0 and doc_id is not null").select("doc_id", "id")
    several = of_id.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last").select("doc_id", "a")
    same_id = materialise(of_id.join(several, "doc_id").filter("a < id").select("a", F.col("id").alias("b")).distinct(), "ngram-same-id")
    found = of_components(classes, labels if same_id.isEmpty() else components(links.unionByName(same_id)))
    least = found.groupBy("component").agg(F.min("low.doc_id").alias("component_id"))
    of_class = found.join(least, "component").select("id", "component_id")
    shingled = members.filter("n > 0").join(of_class, "id", "left")
    alone = members.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return shingled.unionByName(alone, allowMissingColumns=True).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, how: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts, that of the least id, and all that link with nothing.

    Rows without words or without id all stay. Texts that do not link all stay, whether they share an id or not; rows
    that repeat both id and text are copies.
    """
    with storage.scratch(docs.sparkSession) as keep:
        members, classes, _, labels = linked_classes(named(docs, id_col, text_col), how)
        lead = of_components(classes, labels).groupBy("component").agg(F.min("low").alias("low")).select(F.col("low.doc_id").alias("__lead_id"), F.col("low.row").alias("__lead"))
        rows = members.filter("n > 0 and doc_id is not null").groupBy("doc_id", "row").agg(F.count("*").alias("copies"))
        rows = rows.join(lead, (rows["row"] == lead["__lead"]) & (rows["doc_id"] == lead["__lead_id"]), "left")
        # rows that go, or stay once though they are there several times
        doubtful = keep(materialise(rows.filter("__lead is null or copies > 1").select("doc_id", "row", F.col("__lead").isNotNull().alias("__stays")), "ngram-copies"))
    worded = F.coalesce(docs[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & docs[id_col].isNotNull()
    sure, unsure = told_apart(docs.withColumn("__row", F.when(worded, row_name(id_col, text_col))), "__row", doubtful)
    copies = doubtful.select(F.col("doc_id").alias("__id"), F.col("row").alias("__copy"), "__stays")
    met = unsure.join(copies, (unsure["__row"] == copies["__copy"]) & (unsure[id_col].cast("long") == copies["__id"]), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = sure.select(columns).unionByName(met.filter("__stays is null").select(columns))
    if doubtful.filter("__stays").isEmpty():
        return kept
    first = Window.partitionBy("__id", "__copy").orderBy("__copy")
    one = met.filter("__stays").withColumn("__turn", F.row_number().over(first)).filter("__turn = 1")
    return kept.unionByName(one.select(columns))


def told_apart(docs: DataFrame, key: str, wanted: DataFrame, most_log2: int = 27) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows whose ``key`` (a 64-bit hash, null allowed) is sure not to be in ``wanted`` (row), and
    the others, few more than those that are. A bitmap of sixteen bits a key tells where a row is read, so that only the
    second part need be joined, and texts of the first are not shuffled. Beyond 2^most_log2 bits all rows with a key are
    in the second part."""
    bits_log2 = max(16, int(16 * max(1, wanted.count()) - 1).bit_length())
    if bits_log2 > most_log2:
        return docs.filter(F.col(key).isNull()), docs.filter(F.col(key).isNotNull())
    packed = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("row"), bits_log2))

    def known(hashes: pd.Series) -> pd.Series:
        slot = slot_of(hashes.to_numpy(np.int64), bits_log2)
        return pd.Series((packed.value[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool))

    marked = docs.withColumn("__maybe", F.col(key).isNotNull() & F.pandas_udf(known, "boolean")(F.coalesce(key, F.lit(0).cast("long"))))
    return marked.filter("not __maybe").drop("__maybe"), marked.filter("__maybe").drop("__maybe")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
