"""Personal data: weak supervision over candidate spans.

Base spans (email, ip, card, phone) are found by fixed patterns and always stay. Further candidates are the words
that hold digits and touch no base span, and spelled-out addresses. Regex, gazetteer and context labelers vote on
each candidate (for, against, abstain). The counts of all vote-and-shape patterns of the whole corpus, a small table
whatever the size, are what is learned from: expectation-maximisation estimates how reliable each labeler is, and its
posteriors train a logistic span classifier on votes and shape together. Candidates that it accepts become spans of
the kinds ``contact`` (phone-like), ``number`` (long digit runs), ``secret`` (keys, tokens) or ``address``.

Defined cases: null text counts as empty and yields no span; null ids stay null; repeated rows are answered each; texts of any length are
read whole, in time linear in their length; empty tables give no rows; spans are in code points, end exclusive;
spans of one kind never overlap, at equal starts the longer candidate wins; columns other than id and text are
ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

# Fixed patterns of the base kinds, in the order in which kinds are listed.
LOCAL = r"[A-Za-z0-9._%+-]"
DOMAIN = r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # a leftmost match starts with its run of digits: no way back is needed
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("contact", "number", "secret", "address")

#: Words that announce a secret or a number of a person (gazetteer labeler).
SECRET_WORDS = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "api")
PERSON_WORDS = ("phone", "tel", "call", "mobile", "fax", "account", "iban", "ssn", "passport", "card", "id", "mail", "contact")
#: Words that announce a harmless number.
HARMLESS_WORDS = ("version", "chapter", "page", "section", "figure", "table", "license", "cc", "year", "no")
LABELERS = ("shape", "gazetteer", "assignment", "harmless", "length")
Span = tuple[str, int, int]
Pattern = tuple[int, ...]


def small(part: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


class Finder:
    """Base spans and candidates of one text."""

    def __init__(self):
        self.local_back = re.compile(LOCAL).match
        self.domain, self.ip, self.card, self.phone = (re.compile(p) for p in (DOMAIN, IP, CARD, PHONE))
        self.digit = re.compile(r"[0-9]").search
        self.spelled_host = re.compile(r"[\[(] ?at ?[\])] ?[A-Za-z0-9-]++ ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,}+")
        self.spelled_chars = frozenset(string.ascii_letters + string.digits + "._-")
        self.phone_like = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
        self.word = re.compile(r"[A-Za-z0-9_/+=.-]*").match
        self.word_chars = frozenset(string.ascii_letters + string.digits + "_/+=.-")
        self.before = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*\Z")

    def emails(self, text: str) -> list[Span]:
        """Each @ with a domain after it takes the whole run of local characters before it, back to the last match."""
        found, last, at = [], 0, text.find("@")
        while at >= 0:
            start = at
            while start > last and self.local_back(text, start - 1):
                start -= 1
            m = self.domain.match(text, at) if start < at else None
            if m:
                found.append(("email", start, m.end()))
            last = m.end() if m else last if start < at else at + 1
            at = text.find("@", max(at + 1, last))
        return found

    def spelled(self, text: str) -> list[tuple[int, int]]:
        """Addresses with [at] and [dot] in place of the signs; each takes the whole run of characters before it."""
        found, last = [], 0
        for m in self.spelled_host.finditer(text):
            end = m.start() - (m.start() > last and text[m.start() - 1] == " ")
            start = end
            while start > last and text[start - 1] in self.spelled_chars:
                start -= 1
            if start < end:
                found.append((start, m.end()))
            last = m.end()
        return found

    def base(self, text: str) -> list[Span]:
        spans = self.emails(text)
        if not self.digit(text):
            return spans
        spans += [("ip", *m.span()) for m in self.ip.finditer(text) if all(map(small, m.group().split(".")))]
        for m in self.card.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        for m in self.phone.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
        return spans

    def candidates(self, text: str, base: list[Span]) -> list[tuple[Span, Pattern]]:
        """Words with digits and phone-like or spelled-out runs that touch no base span, with their vote patterns."""
        taken, found = sorted((s, e) for _, s, e in base), []
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

        def free(s: int, e: int) -> bool:
            before = bisect_left(starts, e)  # spans that start before e; the furthest end among them decides
            return before == 0 or reach[before - 1] <= s

        if "[at]" in text or "(at)" in text or "[ at" in text or "( at" in text:
            found += [("address", s, e) for s, e in self.spelled(text) if free(s, e)]
        m, first, last = self.digit(text), 0, 0  # first, last: the word that was read before
        while m:
            p = m.start()
            like = self.phone_like.match(text, p - (p > 0 and text[p - 1] == "("))
            if like:
                s, e = like.span()
                kind = "contact"
            else:
                if p >= last:
                    first = p
                    while first > last and text[first - 1] in self.word_chars:
                        first -= 1
                    last = self.word(text, p).end()
                word = text[first:last].rstrip(".=-/+")
                s, e = first, first + len(word)
                kind = "number" if sum(c.isalpha() for c in word) == 0 else "secret"
            e = max(e, p + 1)
            if e - s >= 7 and free(s, e) and (not found or s >= found[-1][2] or found[-1][0] == "address"):
                found.append((kind, s, e))
            m = self.digit(text, e)
        return [(span, self.votes(text, *span)) for span in found]

    def votes(self, text: str, kind: str, s: int, e: int) -> Pattern:
        """(kind number, one vote of each labeler, length class, digit-ratio class, distinct-character class)."""
        word, ahead = text[s:e], text[max(0, s - 40) : s]
        said = (m.group(1).lower() if (m := self.before.search(ahead)) else "")
        digits, size = sum(c.isdigit() for c in word), e - s
        mixed = kind == "secret" and size >= 16 and digits >= 3 and "." not in word
        shape = 1 if mixed or kind in ("contact", "address") or kind == "number" and 9 <= digits <= 19 and "." not in word else -1
        gazetteer = 1 if said in SECRET_WORDS or said in PERSON_WORDS else 0
        assignment = 1 if re.search(r"[=:]\s*[\"']?\Z", ahead) else 0
        harmless = -1 if said in HARMLESS_WORDS or re.fullmatch(r"v?[0-9]{1,4}([./-][0-9]{1,4}){0,3}", word) else 0
        length = 1 if size >= 20 else -1 if size < 9 else 0
        entropy = len(set(word)) / size
        return (ADDED_KINDS.index(kind), shape, gazetteer, assignment, harmless, length, min(5, size // 8), min(3, int(4 * digits / size)), min(3, int(4 * entropy)))


def estimate(counts: dict[Pattern, int], rounds: int = 50) -> tuple[dict[Pattern, float], dict[str, float]]:
    """EM on the counted patterns: the probability of each to be personal, and each labeler's reliability."""
    patterns = sorted(counts)
    votes = np.array([p[1 : 1 + len(LABELERS)] for p in patterns], float)
    n = np.array([counts[p] for p in patterns], float)
    sure, prior = np.full(len(LABELERS), 0.8), 0.5
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        logit = math.log(prior / (1 - prior)) + votes @ np.log(sure / (1 - sure))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        right = np.where(votes > 0, posterior[:, None], 1 - posterior[:, None]) * (votes != 0)
        cast = (votes != 0).T @ n
        sure = np.clip((right.T @ n + 8) / (cast + 10), 0.55, 0.99)  # a labeler counts as better than chance
        prior = min(0.95, max(0.05, float((posterior @ n + 1) / (n.sum() + 2))))
    return dict(zip(patterns, posterior.tolist(), strict=True)), dict(zip(LABELERS, sure.tolist(), strict=True))


def features(pattern: Pattern) -> np.ndarray:
    kind, *votes, size, digits, entropy = pattern
    one_hot = [float(kind == k) for k in range(len(ADDED_KINDS))] + [float(size == k) for k in range(6)] + [float(digits == k) for k in range(4)] + [float(entropy == k) for k in range(4)]
    return np.array([1.0, *votes, *one_hot])


def train(counts: dict[Pattern, int], rounds: int = 300) -> np.ndarray:
    """Weights of a logistic classifier on the soft labels of ``estimate``; each pattern weighs as its logarithm."""
    width = len(features((0,) * (len(LABELERS) + 4)))
    if not counts:
        return np.zeros(width)
    soft, _ = estimate(counts)
    patterns = sorted(counts)
    x, y = np.array([features(p) for p in patterns]), np.array([soft[p] for p in patterns])
    n = np.log1p([counts[p] for p in patterns])
    n, w = n / n.sum(), np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (n * (p - y)) + 1e-4 * w)
    return w


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Classifier weights from the vote patterns of all candidates of all texts (a table of bounded size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, counts = Finder(), Counter()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(a, 512).to_pylist():
                    if text:
                        counts.update(p for _, p in finder.candidates(text, finder.base(text)))
        yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in counts], pa.list_(pa.int64())), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "pattern array<long>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return train({tuple(r.pattern): r.n for r in got})


def accepted(finder: Finder, text: str, base: list[Span], weights: np.ndarray, known: dict[Pattern, float], threshold: float) -> list[tuple[Span, float]]:
    out = []
    for span, pattern in finder.candidates(text, base):
        score = known.get(pattern)
        if score is None:
            score = known[pattern] = float(1 / (1 + np.exp(-features(pattern) @ weights)))
        if score >= threshold:
            out.append((span, score))
    return out


SPANS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long,score:double>>"


def find(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base spans and the accepted further ones with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, known = Finder(), {}
        base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        added_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            base, added = [], []
            for a in range(0, batch.num_rows, 512):
                for text in batch.column(1).slice(a, 512).to_pylist():
                    own = finder.base(text) if text else []
                    base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                    added.append([{"kind": k, "start": s, "end": e, "score": p} for (k, s, e), p in (accepted(finder, text, own, weights, known, threshold) if text else ())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(added, added_type)], names=["doc_id", "base", "added"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SPANS)


def redact(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    ``length_col``, if there, is set anew for changed texts. Null texts stay null.
    """
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, known = Finder(), {}
        for batch in batches:
            texts, sizes = [], batch.column(size_at).to_pylist() if size_at is not None else []
            for a in range(0, batch.num_rows, 512):
                for k, text in enumerate(batch.column(at).slice(a, 512).to_pylist(), a):
                    own = finder.base(text) if text else []
                    spans = own + [s for s, _ in accepted(finder, text, own, weights, known, threshold)] if text else []
                    if spans:
                        parts, last = [], 0
                        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                            if s >= last:
                                parts += [text[last:s], f"<{kind}>"]
                            last = max(last, e)
                        text = "".join([*parts, text[last:]])
                        if sizes:
                            sizes[k] = len(text)
                    texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if size_at is not None:
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)


def listed(spans: list[str] | tuple[str, ...] = BASE_KINDS + ADDED_KINDS) -> dict[str, int]:
    return {k: i for i, k in enumerate(spans)}


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = find(docs, fit(docs))
    order = F.create_map(*[x for k, i in listed().items() for x in (F.lit(k), F.lit(i))])
    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def joined(spans: F.Column) -> F.Column:
        """kind:start:end by kind as listed, then start."""
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    added = F.size("added").cast("long").alias("n_added")  # spans that the method adds to the base ones
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", plain)).alias("spans"), added)
