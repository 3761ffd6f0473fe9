"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are all words of whole texts; weights are (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), with df counted over all
N documents. Words whose presence goes with the label (chi-square over the examples at least ``least_chi_square``) are
weighed up by their relevance log2(2 + share of toxic / share of other examples with the word), all others by 1; no
word is dropped. Examples are a bounded, documented sample: at most ``per_class`` toxic and ``per_class`` other
distinct labelled texts (those of least hash), so copies of a text count once. The index keeps similar examples
together in blocks, postings by term and block, and each term's greatest weight in each block. A query first scores the
blocks of the highest bounds, takes the k-th similarity as threshold, then every other block whose bound reaches it, and
leaves the rest unread: the k nearest are exact, ties going to the smaller example id. Words that no example has count
in a text's norm only; their df is joined, so nothing that grows with the documents is broadcast.

Neighbours vote with weight 1 / (distance + 0.1), scaled to the true shares of the labels; the share of toxic votes is
smoothed by the overall share and calibrated by a logistic fit on leave-one-out votes of the examples. A text that
shares no word with an example has no neighbours and gets the calibrated overall share.

Defined cases: null text counts as empty; rows without id are scored, but not learned from; repeated rows are scored each; a text with several labels counts by their
majority (toxic on a tie), null labels do not count; without labelled rows the score is 0; texts of any length are
read whole; empty tables give no rows; other columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions import storage

from .common import bounded_sample, give_back, lean, materialise, table
from .neighbours import kmeans
from .ngram_join import told_apart

WORD = r"[^\W\d_]+"
LETTERS_OF_ASCII = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 for b in range(256))
SCORED = "doc_id long, score double, neighbours array<struct<example_id:long,similarity:double,toxic:int>>"
NEAR = "doc_id long, text_key string, known double, neighbours array<struct<example_id:long,similarity:double,toxic:int>>, rest array<struct<word:string,tf:long>>"


class BlockMaxIndex:
    """Unit vectors of examples (id, label, {term: tf} or (terms, tfs)) as postings, in blocks of similar examples.

    The ``dense_terms`` most frequent terms, whose postings are the long ones, are kept as a small matrix for each block,
    with each term's greatest weight in each block; the others as postings by term. A block's bound is the greatest sum
    that the rare terms give in it, and the maxima of the frequent ones; a block whose bound cannot reach a query's k-th
    similarity is not multiplied. That is done in single precision; what comes within ``ERROR`` of the k-th is scored anew
    in double precision from the frequent terms that each example has, so results are exact. ``df`` (by term) and ``documents`` are those of
    all documents; without them, those of the examples. Each worker of an executor has an index of its own, so it is built
    and asked in parts of ``PART`` examples and ``ASKED`` queries.
    """

    ERROR = 4e-5  # more than the rounding of sums of 512 single-precision products of unit vectors
    PART, ASKED = 256, 16

    def __init__(self, examples: list[tuple], vocabulary: list[str], block: int = 64, df: np.ndarray | None = None, documents: int = 0, least_chi_square: float = 25.0, dense_terms: int = 512):
        examples = sorted(examples, key=lambda e: e[0])
        self.term = {t: k for k, t in enumerate(vocabulary)}
        self.ids, self.labels = np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.int64)
        n, size = len(examples), len(vocabulary)
        held = [self.counted(e[2])[:2] if isinstance(e[2], dict) else e[2] for e in examples]
        ends = np.cumsum([0] + [len(t) for t, _ in held])
        own = np.repeat(np.arange(n), np.diff(ends))
        term = np.concatenate([t for t, _ in held] + [np.zeros(0, np.int64)]).astype(np.int64)
        tf = np.concatenate([f for _, f in held] + [np.zeros(0)]).astype(np.int64)
        have, toxic = np.bincount(term, minlength=size), np.bincount(term, weights=self.labels[own], minlength=size)
        df, documents = (have, n) if df is None else (df, documents)
        self.idf = np.log((1 + documents) / (1 + df)) + 1
        self.weight = self.idf * relevance(have, toxic, n, int(self.labels.sum()), least_chi_square)
        self.block, self.dense_terms = block, dense_terms
        self.build(ends, term, tf.astype(np.min_scalar_type(int(tf.max(initial=0)))), None)

    def __getstate__(self) -> dict:
        """What the rest can be built from; the parts that it yields are larger."""
        ends, term, tf = self.held
        kept = {k: self.__dict__[k] for k in ("ids", "labels", "idf", "weight", "block", "dense_terms")}
        return kept | {"words": list(self.term), "held": (ends, term, tf, self.example)}

    def __setstate__(self, state: dict) -> None:
        self.term = {t: k for k, t in enumerate(state.pop("words"))}
        ends, term, tf, example = state.pop("held")
        self.__dict__.update(state)
        self.build(ends, term, tf, example)

    def build(self, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, example: np.ndarray | None) -> None:
        """The index of examples whose terms and tfs lie one after the other, ``example`` being their order in blocks."""
        n, size, block = len(self.ids), len(self.term), self.block
        self.held = ends, term.astype(np.int32, copy=False), tf
        self.norm = np.ones(n)
        for a in range(0, n, self.PART):
            own, _, w = self.weights(np.arange(a, min(a + self.PART, n)))
            self.norm[a : a + self.PART] = np.sqrt(np.bincount(own, weights=w * w, minlength=min(self.PART, n - a)))
        self.blocks = max(1, -(-n // block))
        self.example = self.alike() if example is None else example  # by place; places are dealt to blocks in order
        self.place = np.empty(n, np.int32)
        self.place[self.example] = np.arange(n)
        self.row = np.full(size, -1, np.int32)  # of the frequent terms
        have = np.bincount(term, minlength=size)
        frequent = np.argsort(-have, kind="stable")[: min(self.dense_terms, size)]
        self.row[frequent] = np.arange(len(frequent))
        have[frequent] = 0
        self.first = np.r_[0, np.cumsum(have)].astype(np.int32)
        self.dense = np.zeros((self.blocks, len(frequent), block), np.float32)
        self.at, self.w, filled = np.empty(self.first[-1], np.int32), np.empty(self.first[-1]), self.first[:-1].copy()
        often = []  # (frequent terms of each place, rows of ``dense``, weights)
        for a in range(0, n, self.PART):
            own, term, w = self.weights(self.example[a : a + self.PART])
            row, at = self.row[term], own + a
            here = row >= 0
            self.dense[at[here] // block, row[here], at[here] % block] = w[here]
            often.append((np.bincount(own[here], minlength=min(self.PART, n - a)), row[here], w[here]))
            term, at, w = term[~here], at[~here], w[~here]
            order = np.argsort(term, kind="stable")  # places grow within a term
            term = term[order]
            to = filled[term] + np.arange(len(term)) - np.searchsorted(term, term)
            self.at[to], self.w[to] = at[order], w[order]
            np.add.at(filled, term, 1)
        often.append((np.zeros(self.blocks * block - n, np.int64), np.zeros(0, np.int32), np.zeros(0)))
        sizes, self.often_row, self.often_w = map(np.concatenate, zip(*often, strict=True))
        self.often_first = np.r_[0, np.cumsum(sizes)]
        self.dense_top = self.dense.max(axis=2).T if len(frequent) else np.zeros((0, self.blocks), np.float32)

    def weights(self, examples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number within ``examples``, term, weight) of all terms of some examples, one example after the other."""
        ends, term, tf = self.held
        size = ends[examples + 1] - ends[examples]
        own = np.repeat(np.arange(len(examples)), size)
        at = np.repeat(ends[examples] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return own, term[at], (1 + np.log(tf[at].astype(float))) * self.weight[term[at]] / self.norm[examples][own]

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each example."""
        (ends, term, _), (_, _, w) = self.held, self.weights(np.arange(len(self.ids)))
        return [(term[a:b], w[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def alike(self, width: int = 64, centres: int = 40, seed: int = 5) -> np.ndarray:
        """An order in which similar examples lie together (any order gives the same results): by the nearest of a few
        centres, for vectors whose terms are hashed to ``width`` places."""
        rng, n = np.random.default_rng(seed), len(self.ids)
        own, term, w = self.weights(np.arange(n))
        slot, sign = rng.integers(0, width, len(self.term) + 1), rng.choice([-1.0, 1.0], len(self.term) + 1)
        x = np.bincount(own * width + slot[term], weights=sign[term] * w, minlength=n * width).reshape(n, width)
        if n <= self.block:
            return np.arange(n)
        centre = kmeans(x, min(centres, n), 6, seed)
        return np.lexsort((np.arange(n), ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)))

    def counted(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(terms, tfs) of the words that examples have, and the other words."""
        terms, words = np.fromiter(map(self.term.get, tf, repeat(-1)), np.int64, len(tf)), list(tf)
        known = terms >= 0
        return terms[known], np.fromiter(tf.values(), float, len(tf))[known], [words[k] for k in np.flatnonzero(~known).tolist()]

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of the words that examples have."""
        terms, w, norm, _ = self.weighed(tf)
        return terms, w / math.sqrt(norm) if len(terms) else w

    def weighed(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray, float, list[str]]:
        """(terms, weights, sum of squared weights) of the words that examples have, and the other words."""
        terms, n, rest = self.counted(tf)
        w = (1 + np.log(n)) * self.weight[terms]
        return terms, w, float(w @ w), rest

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the positions and similarities of the k most similar examples with a
        similarity above 0, but for example ``without[query]``."""
        m, places = len(queries), self.blocks * self.block
        asker, term = np.repeat(np.arange(m), [len(t) for t, _ in queries]), np.concatenate([t for t, _ in queries]).astype(np.int64)
        weight, row = np.concatenate([w for _, w in queries]), self.row[term]
        here = row >= 0
        q = np.zeros((m, len(self.dense_top)))
        q[asker[here], row[here]] = weight[here]
        single = q.astype(np.float32)
        asker, term, weight = asker[~here], term[~here], weight[~here]
        rare, parts = np.empty((m, places)), np.searchsorted(asker, np.arange(0, m + self.ASKED, self.ASKED))
        for a, (b, c) in zip(range(0, m, self.ASKED), zip(parts[:-1], parts[1:], strict=True), strict=False):
            size = self.first[term[b:c] + 1] - self.first[term[b:c]]
            posting = np.repeat(self.first[term[b:c]] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            own = rare[a : a + self.ASKED]
            own[:] = np.bincount(np.repeat((asker[b:c] - a) * places, size) + self.at[posting], weights=np.repeat(weight[b:c], size) * self.w[posting], minlength=own.size).reshape(own.shape)
        if without is not None:
            rare[np.arange(m), self.place[without]] = -np.inf
        bound = single @ self.dense_top + rare.reshape(m, self.blocks, self.block).max(axis=2)
        scores = np.full((m, places), -np.inf)

        def add(wanted: np.ndarray) -> None:
            """Scores the blocks that each query wants."""
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                own, at = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                scores[own, at] = rare[own, at] + ((single @ self.dense[b])[own] if 2 * len(own) > m else single[own] @ self.dense[b])

        best = np.zeros((m, self.blocks), bool)
        top = np.argsort(-bound, axis=1, kind="stable")[:, : -(-2 * k // self.block)]
        np.put_along_axis(best, top, True, axis=1)
        add(best)
        first = np.take_along_axis(scores.reshape(m, self.blocks, self.block), top[:, :, None], axis=1).reshape(m, -1)
        floor = np.maximum(np.partition(first, -k, axis=1)[:, -k], 0) - self.ERROR if first.shape[1] >= k else np.zeros(m)
        add((bound > 0) & (bound >= floor[:, None]) & ~best)
        close = []
        for own, least in zip(scores, floor, strict=True):
            places_of = np.flatnonzero((own > 0) & (own >= least - self.ERROR))
            if len(places_of) > k:
                places_of = places_of[own[places_of] >= np.partition(own[places_of], -k)[-k] - 2 * self.ERROR]
            close.append(places_of)
        out = []
        for a in range(0, m, self.ASKED):
            part = close[a : a + self.ASKED]
            ends, at = np.cumsum([0] + [len(x) for x in part]), np.concatenate(part)
            asked = np.repeat(np.arange(a, a + len(part)), np.diff(ends))
            size = self.often_first[at + 1] - self.often_first[at]
            held = np.repeat(self.often_first[at] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            products = self.often_w[held] * q[np.repeat(asked, size), self.often_row[held]]
            exact = np.round(rare[asked, at] + np.bincount(np.repeat(np.arange(len(at)), size), weights=products, minlength=len(at)), 12)  # equal vectors tie, however their sums were rounded
            for b, c in zip(ends[:-1], ends[1:], strict=True):
                order = np.lexsort((self.example[at[b:c]], -exact[b:c]))[:k]
                out.append((self.example[at[b:c][order]], np.minimum(exact[b:c][order], 1.0)))
        return out


def relevance(have: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int, least_chi_square: float) -> np.ndarray:
    """Factor of each word, 1 at least: more for words that go with toxic examples."""
    n_other = n - n_toxic
    if not n_toxic or not n_other:
        return np.ones(len(have))
    other, c = have - toxic, have.astype(float)
    chi = n * (toxic * (n_other - other) - other * (n_toxic - toxic)) ** 2 / (float(n_toxic) * n_other * c * (n - c) + 1e-9)
    ratio = (toxic / n_toxic) / (np.maximum(other, 1) / n_other)
    return np.where(chi >= least_chi_square, np.log2(2 + ratio), 1.0)


class Model:
    """``frequencies``: (word, df) over all ``documents`` documents; it stays on the driver."""

    def __init__(self, index: BlockMaxIndex, share: float, k: int, frequencies: DataFrame | None = None, documents: int = 0):
        self.index, self.share, self.k = index, share, k
        self.frequencies, self.documents = frequencies, documents
        toxic = max(1, int(index.labels.sum()))
        other = max(1, len(index.labels) - toxic)
        self.of_label = ((1 - share) / other * len(index.labels), share / toxic * len(index.labels))
        self.scale = np.where(index.labels == 1, self.of_label[1], self.of_label[0])
        self.slope, self.shift = 1.0, 0.0

    def votes(self, found: np.ndarray, similarity: np.ndarray) -> float:
        w = self.scale[found] / (1 - similarity + 0.1)
        return float((w @ self.index.labels[found] + self.share) / (w.sum() + 1))

    def calibrate(self, rounds: int = 25) -> Model:
        """Logistic fit of the labels on the logit of leave-one-out votes, weighted to the true shares."""
        vectors, raw = self.index.vectors, []
        for a in range(0, len(vectors), 64):
            own = vectors[a : a + 64]
            raw += [self.votes(*found) for found in self.index.nearest_of(own, self.k, without=np.arange(a, a + len(own)))]
        raw = np.array(raw)
        x, y, n = logit(raw), self.index.labels, self.scale
        a, b = 1.0, 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(n * (p - y) * x).sum() + 0.1 * (a - 1), (n * (p - y)).sum()])
            v = n * p * (1 - p) + 1e-9
            h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        self.slope, self.shift = max(a, 0.1), b
        return self

    def score_of(self, neighbours: Column) -> Column:
        """The calibrated share of toxic votes, as ``votes`` and ``calibrate`` have it."""
        weight = lambda x: F.when(x["toxic"] == 1, F.lit(self.of_label[1])).otherwise(F.lit(self.of_label[0])) / (1 - x["similarity"] + 0.1)
        every = F.aggregate(neighbours, F.lit(0.0), lambda acc, x: acc + weight(x))
        toxic = F.aggregate(neighbours, F.lit(0.0), lambda acc, x: acc + weight(x) * x["toxic"])
        p = F.least(F.greatest((toxic + self.share) / (every + 1), F.lit(1e-4)), F.lit(1 - 1e-4))
        return 1 / (1 + F.exp(-(self.slope * F.log(p / (1 - p)) + self.shift)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@cache
def letters(most: int = 0x20000) -> np.ndarray:
    """Whether ``WORD`` takes each of the first code points."""
    taken = np.zeros(most, bool)
    for run in re.finditer(WORD, "".join(map(chr, range(most)))):
        taken[run.start() : run.end()] = True
    return taken


def words_in(text: str, most: int = 1 << 20) -> list[str]:
    """``re.findall(WORD, text.lower())`` in less time: what ``WORD`` does not take becomes a space, at which ``split`` cuts.
    The pattern itself reads rare scripts, and texts of over ``most`` characters, which would take four bytes each."""
    if text.isascii():
        return text.encode().translate(LETTERS_OF_ASCII).decode("ascii").split()
    lower = text.lower()
    if len(lower) <= most:
        points, known = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4"), letters()
        if points.max() < len(known):
            return np.where(known[points], points, np.uint32(32)).astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass").split()
    return re.findall(WORD, lower)


def term_counts(text: str | None) -> Counter:
    return Counter(words_in(text)) if text else Counter()


def key_of(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def document_frequencies(docs: DataFrame, text_col: str = "text", most: int = 100_000) -> DataFrame:
    """(word, df) over all rows; the row of the empty word has the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["word", "df"])
            df.clear()
            return got

        for batch in batches:
            df[""] += batch.num_rows
            for a in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(a, 512).to_pylist():
                    if text:
                        df.update(set(words_in(text)))
                if len(df) > most:
                    yield out()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = 3000, least_chi_square: float = 25.0, k: int = 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """``learn`` is a condition on the id column of the labels; None without labelled texts."""
    known = labels.filter(F.lit(True) if learn is None else learn).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
    known = known.filter("id is not null and label is not null").groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    if share is None:
        return None
    texts = docs.select(F.col(id_col).cast("long").alias("id"), key_of(F.col(text_col)).alias("key")).join(known, "id")
    texts = materialise(texts.groupBy("key").agg((F.avg("label") >= 0.5).cast("int").alias("label"), F.min("id").alias("id")), "toxicity-texts")
    chosen = bounded_sample(texts, "label", "key", per_class)
    examples = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key_of(F.col(text_col)).alias("key"))
    examples = examples.join(F.broadcast(chosen), ["id", "key"]).dropDuplicates(["key"]).select("id", "key", "label", "text")  # 2 * per_class rows at most

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tfs = [term_counts(text) for text in batch.column(3).to_pylist()]
            counts = [pa.array([list(tf) for tf in tfs], pa.list_(pa.string())), pa.array([list(tf.values()) for tf in tfs], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts], names=["id", "key", "label", "words", "tfs"])

    counts = materialise(examples.mapInArrow(lean(words), "id long, key string, label int, words array<string>, tfs array<long>"), "toxicity-words")
    frequencies = materialise(document_frequencies(docs, text_col), "toxicity-df")
    vocabulary = counts.select(F.explode("words").alias("word")).distinct().join(frequencies, "word").toArrow()
    vocabulary = vocabulary.sort_by([("df", "descending"), ("word", "ascending")])  # words that texts often ask for lie together in a worker's memory
    documents = frequencies.filter("word = ''").agg(F.sum("df")).first()[0] or 0
    storage.delete(docs.sparkSession, texts.written_to)
    held = counts.toArrow().sort_by([("id", "ascending"), ("key", "ascending")])
    if not held.num_rows:
        return None
    examples_of = []
    for batch in held.to_batches():
        of_words, of_tfs = batch.column(3), batch.column(4)
        term, tf = pc.index_in(of_words.flatten(), value_set=vocabulary.column(0)).to_numpy(zero_copy_only=False).astype(np.int64), of_tfs.flatten().to_numpy().astype(float)
        ends = np.r_[0, np.cumsum(pc.list_value_length(of_words).to_numpy(zero_copy_only=False))]
        for e, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            order = np.argsort(term[a:b], kind="stable")
            examples_of.append((batch.column(0)[e].as_py(), batch.column(2)[e].as_py(), (term[a:b][order].astype(np.int32), tf[a:b][order].astype(np.int32))))
    words_of, df = vocabulary.column(0).to_pylist(), vocabulary.column(1).to_numpy(zero_copy_only=False)
    del held, batch, of_words, of_tfs, vocabulary
    pa.default_memory_pool().release_unused()
    index = BlockMaxIndex(examples_of, words_of, df=df, documents=documents, least_chi_square=least_chi_square)
    del examples_of
    return Model(index, float(share), k, frequencies, documents).calibrate()


def listed(sizes: list[int], columns: list[pa.Array], names: list[str]) -> pa.ListArray:
    """Rows of lists of structs."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.StructArray.from_arrays(columns, names=names))


def nearest_examples(docs: DataFrame, shared: Broadcast, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, with the k nearest examples of the index, similarities by the norm of the words that examples
    have (``known``: its square), and the words that none has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, {}
        give_back()  # what loading the index took beside it
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                keys = part.column(1).to_pylist()
                new = {key: term_counts(text) for key, text in zip(keys, part.column(2).to_pylist(), strict=True) if key not in seen}
                weighed = [own.weighed(tf) for tf in new.values()]
                found = own.nearest_of([(terms, w / math.sqrt(norm) if norm else w) for terms, w, norm, _ in weighed], k) if new else []
                if len(seen) > 500:
                    seen = {key: seen[key] for key in keys if key in seen}
                for (key, tf), (_, _, norm, rest), (at, similarity) in zip(new.items(), weighed, found, strict=True):
                    seen[key] = norm, own.ids[at], similarity, own.labels[at].astype(np.int32), rest, [tf[t] for t in rest]
                norms, ids, similarities, labels, rest, tfs = zip(*(seen[key] for key in keys), strict=True)
                near = listed([len(x) for x in ids], [pa.array(np.concatenate(x)) for x in (ids, similarities, labels)], ["example_id", "similarity", "toxic"])
                words = listed([len(x) for x in rest], [pa.array(list(chain.from_iterable(rest)), pa.string()), pa.array(list(chain.from_iterable(tfs)), pa.int64())], ["word", "tf"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(norms, pa.float64()), near, words], names=["doc_id", "text_key", "known", "neighbours", "rest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(lean(run), NEAR)


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, score, neighbours: a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model.index)  # bounded by the words of 2 * per_class texts
    near = materialise(nearest_examples(docs, shared, model.k, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "toxicity-near")
    shared.destroy()  # the table holds all that it was for; workers that are kept drop it
    words = near.filter("size(neighbours) > 0").select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.tf")
    idf = F.log((1 + F.lit(float(model.documents))) / (1 + F.coalesce("df", F.lit(0)))) + 1
    rest = words.join(model.frequencies, "word", "left").groupBy("row").agg(F.sum(F.pow((1 + F.log("tf")) * idf, 2)).alias("unknown"))
    part = F.sqrt(F.col("known") / (F.col("known") + F.coalesce("unknown", F.lit(0.0))))
    similar = F.transform("neighbours", lambda x: F.struct(x["example_id"].alias("example_id"), F.round(x["similarity"] * F.col("part"), 12).alias("similarity"), x["toxic"].alias("toxic")))
    rows = near.drop("rest").join(rest, "row", "left").withColumn("part", part).withColumn("neighbours", similar)
    return rows.select("doc_id", "text_key", model.score_of(F.col("neighbours")).alias("score"), "neighbours")


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its score and the neighbours that speak for it."""
    if model is None:
        none = F.array().cast("array<struct<example_id:long,similarity:double,toxic:int>>")
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), none.alias("neighbours"))
    return judged(docs, model, id_col, text_col).select("doc_id", "score", "neighbours")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text", most_log2: int = 27) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; the score depends on the text only.

    A bitmap of the toxic texts (``told_apart``) tells most rows clean where they are read, so only the rows that look
    toxic are joined with the toxic texts.
    """
    if model is None:
        return docs
    rows = docs.select(F.lit(0).alias("__no"), F.col(text_col).alias("__text"))
    with storage.scratch(docs.sparkSession) as keep:
        toxic = keep(materialise(judged(rows, model, "__no", "__text").filter(F.col("score") >= threshold).select(F.col("text_key").alias("__toxic_key")).distinct(), "toxicity-toxic"))
    hashed = toxic.select(F.xxhash64("__toxic_key").alias("row"))
    clean, doubtful = told_apart(docs.withColumn("__hash", F.xxhash64(key_of(docs[text_col]))), "__hash", hashed, most_log2)
    kept = doubtful.withColumn("__key", key_of(F.col(text_col))).join(toxic, F.col("__key") == F.col("__toxic_key"), "left_anti")
    return clean.drop("__hash").unionByName(kept.drop("__hash", "__key"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
