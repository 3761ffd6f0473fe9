"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur in a text with up to e = floor(error_rate * n) edits. Cut into e + 1 pieces, one
piece at least must occur unchanged, whatever the edits. An automaton over all pieces finds the exact hits in one pass
over each text; around the hits of an item, Myers' bit-parallel recurrence gives the least edit distance of the whole
item to any part of the text. Texts and items are compared in lower case with runs of white space as one space.

Items go to the tasks in blocks of at most ``block_chars`` characters, one pass over the texts for each block, so what
is sent does not grow with the list of items.

Defined cases: null or empty texts and items match nothing; documents without id are matched like others; items too short for an edit must occur exactly; repeated
rows of documents are answered each, repeated items once for each item id; texts of any length are read whole; of
equally near places the leftmost counts; empty tables give no rows; columns other than ids and texts are ignored by
``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

MATCH = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces (offset, text) of nearly equal length; a longer budget than characters is cut to them."""
    n = min(errors + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, end of the first such part): Myers' recurrence."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        equal[c] |= 1 << k
    plus, minus, score, best = full, 0, m, (m, 0)
    for at, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # a match may start anywhere: row 0 costs nothing
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best[0]:
            best = (score, at)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(i, normal(t)) for i, t in items]
        self.items = sorted({x for x in self.items if x[1]})
        self.errors = [int(error_rate * len(t)) for _, t in self.items]
        starts: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            for at, piece in pieces(t, self.errors[k]):
                starts[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in starts.items():
            self.automaton.add_word(piece, (len(piece), where))
        if starts:
            self.automaton.make_automaton()
        self.any = bool(starts)

    def __call__(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of every item that occurs; positions are those of the given text."""
        if not text or not self.any:
            return []
        plain = normal(text)
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(plain):
            for k, at in where:
                diagonals[k].add(end + 1 - size - at)
        found: dict[int, tuple[int, int, int]] = {}
        for k in sorted(diagonals):
            (item, pattern), errors = self.items[k], self.errors[k]
            best: tuple[int, int, int] | None = None
            for a, b in windows(sorted(diagonals[k]), len(pattern), errors, len(plain)):
                distance, end = nearest(pattern, plain[a:b])
                if distance <= errors and (best is None or distance < best[0]):
                    _, back = nearest(pattern[::-1], plain[max(a, a + end - len(pattern) - errors) : a + end][::-1])
                    best = (distance, a + end - back, a + end)
            if best and (item not in found or best < found[item]):
                found[item] = best
                if first_only:
                    break
        if not found:
            return []
        if first_only:
            return [(i, d, -1, -1) for i, (d, _, _) in found.items()]
        at = places(text, plain)
        return [(i, d, at(s), at(e - 1) + 1) for i, (d, s, e) in sorted(found.items())]


def windows(diagonals: list[int], size: int, errors: int, limit: int) -> Iterator[tuple[int, int]]:
    """Merged stretches of text in which an item with these diagonals can lie."""
    a = b = None
    for d in diagonals:
        s, e = max(0, d - errors), min(limit, d + size + errors)
        if b is not None and s <= b:
            b = max(b, e)
        else:
            if b is not None:
                yield a, b
            a, b = s, e
    if b is not None:
        yield a, b


def places(text: str, plain: str) -> Callable[[int], int]:
    """From positions of the normal form to those of the text."""
    origin: list[int] = []
    for m in re.finditer(r"\S+", text):
        if origin:
            origin.append(m.start() - 1)
        for k, c in enumerate(m.group(), m.start()):
            origin.extend([k] * len(c.lower()))
    return lambda p: origin[min(p, len(origin) - 1)] if origin else 0


def blocks(benchmark: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, block_chars: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and item that occurs in it: the least distance and where."""
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for items in blocks(benchmark, block_chars, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for batch in batches:
                got = []
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        got += [(doc, *m) for m in matcher(text)]
                cols = list(zip(*got, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "item_id", "distance", "start", "end"])

        own = rows.mapInArrow(lean(run), MATCH)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else rows.sparkSession.createDataFrame([], MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, block_chars: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item occurs; no shuffle."""
    at = docs.columns.index(text_col)
    for items in blocks(benchmark, block_chars, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, error_rate)
            for batch in batches:
                keep = []
                for a in range(0, batch.num_rows, 512):
                    keep += [not matcher(text, first_only=True) for text in batch.column(at).slice(a, 512).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
