"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings, with an allow-list.

Base spans (assign, access, hex) come from fixed patterns and always stay. Candidates of the method are maximal runs of
``[A-Za-z0-9+/=_-]`` that touch no base span. A candidate belongs to the narrowest character class that holds it (hex,
alnum, base64, url64); the class sets the window and the least share of the class's possible entropy. The window slides
over the candidate one character at a time: one count falls, one rises, and the entropy follows from the change of the sum
of c * log2(c). These terms are integers (units of 2^-40), so a sum of any number of changes is exact. Windows that reach
the share and hold both a letter and a digit are hits; overlapping or adjacent hits make one span. Allow-listed candidates
give none: slugs of words and short numbers, UUIDs, stretches of an alphabet, placeholders, and strings that the caller
names (a set whose size the caller bounds; it goes out with the task).

Defined cases: null text counts as empty and yields no span; a null id stays null; repeated rows are answered each; texts
and candidates of any length are read whole, in time linear in their length and memory of one text; empty tables give no
rows; spans are in code points, end exclusive; spans of equal start go by kind as listed; only A-Z and a-z are
letters, in patterns as in windows; columns other than id and text are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed patterns of the base kinds, in the order in which kinds are listed; the least lengths are applied to whole matches
# (of assign: to its second group), and a match that fails is passed over.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run that is long enough matches from its first character, a shorter one nowhere
LEAST_VALUE, LEAST_ACCESS = 8, 16
BASE_KINDS = ("assign", "access", "hex")
#: What every match of ASSIGN has in it, in lower case.
KEYWORD_PARTS = ("passw", "secret", "token", "api")

Span = tuple[str, int, int]
UNIT = 1 << 40


class CharacterClass(NamedTuple):
    kind: str
    pattern: str
    size: int
    window: int
    share: float


#: From the narrowest to the widest.
CLASSES = (
    CharacterClass("entropy_hex", r"[0-9a-f]+|[0-9A-F]+", 16, 24, 0.80),
    CharacterClass("entropy_alnum", r"[A-Za-z0-9]+", 62, 20, 0.88),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/]+=*", 65, 24, 0.88),
    CharacterClass("entropy_url64", r"[A-Za-z0-9_=-]+", 65, 24, 0.88),
)
ADDED_KINDS = tuple(c.kind for c in CLASSES)
RUN = r"[A-Za-z0-9+/=_-]"

#: Candidates that are no secrets: whole candidates for the first, parts for the second.
ALLOWED_WHOLE = (
    r"(?:[/+=_-]|[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[A-Z]+?(?=[A-Z][a-z]{2})|(?<![0-9])[0-9]{1,4}+(?![0-9]))++",  # slugs, paths, identifiers of words
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",  # UUID
)
ALLOWED_PART = r"(?i:example|placeholder|changeme|dummy|xxxx|0123456789|abcdefgh)"


def terms(window: int) -> list[int]:
    """c * log2(c) for every count that a window can hold, in units of 2^-40."""
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))]


class Sliding:
    """Entropy of all windows of one class, by incremental counts."""

    def __init__(self, of: CharacterClass):
        self.window, self.term = of.window, terms(of.window)
        #: A window is a hit if the sum of its terms is at most this.
        self.most = round(of.window * (math.log2(of.window) - of.share * math.log2(min(of.window, of.size))) * UNIT)

    def hits(self, word: str) -> list[tuple[int, int, float]]:
        """(start, end, largest entropy of a window in it) of each stretch of hits, in order."""
        w, term, count, out = self.window, self.term, {}, []
        total = digits = letters = 0
        for k, c in enumerate(word):
            n = count.get(c, 0)
            count[c] = n + 1
            total += term[n + 1] - term[n]
            digits += c.isdigit()
            letters += c.isalpha()
            if k >= w:
                gone = word[k - w]
                n = count[gone]
                count[gone] = n - 1
                total += term[n - 1] - term[n]
                digits -= gone.isdigit()
                letters -= gone.isalpha()
            if k >= w - 1 and total <= self.most and digits and letters:
                start, bits = k + 1 - w, math.log2(w) - total / (w * UNIT)
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], k + 1, max(out[-1][2], bits))
                else:
                    out.append((start, k + 1, bits))
        return out


class Scanner:
    """All spans of one text."""

    def __init__(self, allowed: Iterable[str] = (), allowed_whole: Iterable[str] = ALLOWED_WHOLE, allowed_part: str | None = ALLOWED_PART):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX)
        least = min(c.window for c in CLASSES)
        self.run = re.compile(rf"(?<!{RUN}){RUN}{{{least},}}")
        self.classes = [(c.kind, re.compile(c.pattern).fullmatch, Sliding(c)) for c in CLASSES]
        self.allowed = frozenset(allowed)
        self.allowed_whole = [re.compile(p).fullmatch for p in allowed_whole]
        self.allowed_part = re.compile(allowed_part).search if allowed_part else lambda word: None

    def base(self, text: str) -> list[Span]:
        low, spans = text.lower(), []
        if any(part in low for part in KEYWORD_PARTS):
            spans += [("assign", *m.span()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST_VALUE]
        if "AKIA" in text:
            spans += [("access", *m.span()) for m in self.access.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        return spans + [("hex", *m.span()) for m in self.hex.finditer(text)]

    def suppressed(self, word: str) -> bool:
        return word in self.allowed or self.allowed_part(word) is not None or any(p(word) for p in self.allowed_whole)

    def added(self, text: str, base: list[Span]) -> list[tuple[str, int, int, float]]:
        starts, ends, out = sorted(s for _, s, _ in base), sorted(e for _, _, e in base), []
        for m in self.run.finditer(text):
            s, e = m.span()
            if bisect_left(starts, e) > bisect_left(ends, s + 1):  # more base spans begin before its end than end before its start
                continue
            word = m[0]
            kind, sliding = next(((kind, sliding) for kind, holds, sliding in self.classes if holds(word)), (None, None))
            if kind and len(word) >= sliding.window and not self.suppressed(word):
                out += [(kind, s + a, s + b, bits) for a, b, bits in sliding.hits(word)]
        return out


BASE_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
ADDED_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entropy", pa.float64())]))
SPANS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long,entropy:double>>"
BATCH = 512


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **allow_list) -> DataFrame:
    """One row per document: base spans, and the method's spans with the largest entropy (bits a character) in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**allow_list)
        for batch in batches:
            base, added = [], []
            for a in range(0, batch.num_rows, BATCH):
                for text in batch.column(1).slice(a, BATCH).to_pylist():
                    own = scanner.base(text) if text else []
                    base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                    added.append([{"kind": k, "start": s, "end": e, "entropy": bits} for k, s, e, bits in (scanner.added(text, own) if text else ())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, BASE_TYPE), pa.array(added, ADDED_TYPE)], names=["doc_id", "base", "added"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def redact(docs: DataFrame, text_col: str = "text", **allow_list) -> DataFrame:
    """``docs`` with every stretch of overlapping spans replaced by the kind of its first span; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**allow_list)
        for batch in batches:
            texts = []
            for a in range(0, batch.num_rows, BATCH):
                for text in batch.column(at).slice(a, BATCH).to_pylist():
                    if text:
                        own, parts, last = scanner.base(text), [], 0
                        for kind, s, e in sorted([*own, *(x[:3] for x in scanner.added(text, own))], key=lambda x: (x[1], (BASE_KINDS + ADDED_KINDS).index(x[0]))):
                            if s >= last:
                                parts += [text[last:s], f"<{kind}>"]
                            last = max(last, e)
                        text = "".join([*parts, text[last:]])
                    texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.create_map(*[x for i, k in enumerate(BASE_KINDS + ADDED_KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(table(spark, sf_dir, "documents"))
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    added = F.size("added").cast("long").alias("n_added")  # spans that the method adds to the base ones
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", plain)).alias("spans"), added)
