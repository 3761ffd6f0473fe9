"""Importance resampling towards a target: hashed word runs, bucket gains, Gumbel draws.

A text's features are its runs of 1 to ``longest`` words, joined by one space; each falls in the bucket of its CRC-32.
``Vocabulary`` is the head of the features: the words that fill much of the corpus with the CRC states of their bytes, and
the pairs that do, with theirs. It goes out with the tasks (``head`` words and as many pairs at most). A word of the tail
takes its CRC from its bytes, and a run goes on from the state of the run that is one word shorter, so that head and tail
give the same bucket and the totals are exact whatever the head holds. The head comes from counts of all texts: a task keeps
at most 4 * ``head`` counts (when these are full, all fall by what the middle one has, and spent ones go, so that a word
with more than about 1 / (2 * ``head``) of a task's words stays), and the sums over tasks decide.

``totals`` counts all buckets of all texts, ``gains`` compares corpus and target, ``weigh`` takes the mean gain of a text's
features and adds the draw's noise, which depends on seed and id alone. ``resample`` ranks what is drawn: a histogram of
scores (they are whole numbers within narrow bounds, so it stays small) gives the least score that is drawn; rows that
reach it are dealt in ranges of their order and numbered by running totals of the ranges. No task sees all rows.

Defined cases: null and empty texts have no features and weight 0; a null id draws as the empty id and comes before others
on ties; repeated rows are drawn each, in any order; with an empty target or corpus the gains compare with 0 features;
words of any length count whole; empty tables give no rows; columns other than id and text are ignored. Target texts that
are null count for nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Words of lower-cased UTF-8: digits, a-z and all that is not ASCII. bytes.lower() touches A-Z only.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
BATCH, PIECE = 512, 1 << 20


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, by pieces of about a megabyte, so that a long text is never a list of words as a whole."""
    raw, a = (text or "").encode(), 0
    while a < len(raw):
        gap = GAP.search(raw, a + PIECE) if a + PIECE < len(raw) else None
        b = gap.start() if gap else len(raw)
        yield WORD.findall(raw[a:b].lower())
        a = b


class Vocabulary:
    """CRC states of frequent words and, by their joined bytes, of frequent pairs; the rest is computed when it is met."""

    def __init__(self, words: list[bytes], pairs: list[bytes], longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.words = Tail({w: zlib.crc32(w) for w in words})
        self.pairs = {p: zlib.crc32(p) for p in pairs}

    def states(self, words: list[bytes], old: int) -> Iterator[list[int]]:
        """CRC-32 of all runs of one word, of two, and so on, that do not end within the first ``old`` words."""
        state = [self.words[w] for w in words]
        yield state[old:]
        for k in range(2, self.longest + 1):
            if k == 2 and self.pairs:
                known = self.pairs.get
                state = [c if (c := known(a + b" " + b)) is not None else zlib.crc32(b" " + b, s) for s, a, b in zip(state, words, words[1:], strict=False)]
            else:
                state = [zlib.crc32(b" " + w, s) for s, w in zip(state, words[k - 1 :], strict=False)]
            yield state[max(0, old - k + 1) :]

    def features(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """(number of words, bucket of each feature) by pieces; runs go on from one piece to the next."""
        last: list[bytes] = []
        for words in pieces(text):
            known = last + words
            states = np.array([s for part in self.states(known, len(last)) for s in part], np.uint32)
            yield len(words), (states % np.uint32(self.buckets)).astype(np.int64)
            last = known[len(known) - self.longest + 1 :] if self.longest > 1 else []


class Tail(dict):
    """States of known words; others take the CRC of their bytes and are not kept."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Heavy:
    """Counts of what is frequent, in bounded memory."""

    def __init__(self, most: int):
        self.most, self.counts = most, Counter()

    def update(self, features: Iterator[bytes] | list[bytes]) -> None:
        self.counts.update(features)
        if len(self.counts) > self.most:
            level = sorted(self.counts.values())[len(self.counts) - self.most // 2]
            self.counts = Counter({f: n - level for f, n in self.counts.items() if n > level})


def vocabulary(docs: DataFrame, longest: int, buckets: int, head: int = 1 << 15, text_col: str = "text") -> Vocabulary:
    """The ``head`` most frequent words, and as many pairs where runs of two count; words over 64 bytes stay in the tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = [Heavy(4 * head) for _ in range(min(longest, 2))]
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                for text in batch.column(0).slice(a, BATCH).to_pylist():
                    for words in pieces(text):
                        heavy[0].update([w for w in words if len(w) <= 64])
                        if longest > 1:
                            heavy[1].update([x + b" " + y for x, y in zip(words, words[1:], strict=False) if len(x) + len(y) <= 63])
        for size, h in enumerate(heavy, 1):
            top = h.counts.most_common(head)
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(top), pa.int32()), pa.array([f for f, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["size", "feature", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "size int, feature binary, n long").groupBy("size", "feature").agg(F.sum("n").alias("n"))
    top = [[bytes(r.feature) for r in counted.filter(F.col("size") == k).orderBy(F.desc("n"), "feature").limit(head).collect()] for k in range(1, min(longest, 2) + 1)]
    return Vocabulary(top[0], top[1] if longest > 1 else [], longest, buckets)


def totals(docs: DataFrame, known: Vocabulary, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: a task sends one row for each bucket that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(known.buckets, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                met = [np.zeros(0, np.int64)]
                for text in batch.column(0).slice(a, BATCH).to_pylist():
                    for _, bucket in known.features(text):
                        met.append(bucket)
                        if len(bucket) > PIECE // 8:  # long pieces are not gathered
                            total += np.bincount(met.pop(), minlength=known.buckets)
                total += np.bincount(np.concatenate(met), minlength=known.buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    out = np.zeros(known.buckets, np.int64)
    for row in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the target's smoothed share over the corpus's) of every bucket."""
    s, t, buckets = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, known: Vocabulary, gain: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for a in range(0, batch.num_rows, BATCH):
                for text in batch.column(1).slice(a, BATCH).to_pylist():
                    n_words = n_features = total = 0
                    for n, bucket in known.features(text):
                        n_words, n_features, total = n_words + n, n_features + len(bucket), total + int(gain[bucket].sum())
                    sizes.append((n_words, n_features, total // max(1, n_features)))
            columns = [pa.array(c, pa.int64()) for c in zip(*sizes, strict=True)] if sizes else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, order: list, partitions: int) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, ... in their order: dealt in ranges, numbered within them, moved by totals of ranges."""
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, before, offsets = F.shiftright("__at", 33), 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per range
        offsets.append((r.part, before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    at = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn("rank", F.col("__before") + at + 1).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, head: int = 1 << 15, rows_per_range: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_features, weight, score and, if it is drawn, its rank."""
    known = vocabulary(docs, longest, buckets, head, text_col)
    gain = gains(totals(docs, known, text_col), totals(target, known, text_col))
    scored = materialise(weigh(docs, known, gain, seed, id_col, text_col), "weights")
    able = F.col("n_words") >= least_words
    scores = sorted(((r.score, r.n) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw, held, least = percent * sum(n for _, n in scores) // 100, 0, None
    for score, n in scores:
        if held >= draw:
            break
        held, least = held + n, score
    reach = F.lit(False) if least is None else able & (F.col("score") >= least)
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(~reach).select(*columns, F.lit(None).cast("long").alias("rank"))
    if least is None:
        return rest
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("__row")]
    # __row parts the rows of an id that a third of all rows may share
    drawn = ranked(scored.filter(reach).withColumn("__row", F.monotonically_increasing_id()), order, max(1, -(-held // rows_per_range)))
    return drawn.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")).unionByName(rest)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
