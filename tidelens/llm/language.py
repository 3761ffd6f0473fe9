"""Language identification: a byte convolutional network in numpy.

One-hot bytes go through filters of several widths, a maximum over the positions of a fixed-length window, a
rectifier and a softmax. A filter of width w is a table (w, 256, filters): its response at a position is the sum of
w table rows, so no byte is ever expanded to a one-hot vector. Every byte of a text is covered: the text is cut into
windows, the windows of a batch are scored together, and a text's probabilities are the means over its windows.

The fit sees a bounded sample, ``per_language`` texts (those of least hash) of each language and up to
``windows_per_text`` windows of each; the bound is a parameter. Nothing but text and language of rows with
crc32(id as text) mod 3 <> 1 and a language is learned from; prediction reads the text alone.

Defined cases: null text or a text without letters (category L of Unicode) is ``und`` with score 0; null ids stay null; empty tables give no rows; without any
row to learn from every text is ``und``; repeated rows are answered each and learned from once (of rows that share id
and language, the text that is first in order); ties go to the language first in order;
texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, slices, table, text_bytes

UNKNOWN = "und"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class ByteCnn:
    """widths: filter widths; tables: one (w, 256, filters) array each; bias, dense (features, languages), offset."""

    def __init__(self, languages: list[str], widths=(2, 3, 4), filters: int = 8, window: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.widths, self.filters, self.window = languages, widths, filters, window
        self.tables = [rng.normal(0, 0.3 / w**0.5, (w, 256, filters)).astype(np.float32) for w in widths]
        n = filters * len(widths)
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """x (rows, window) of bytes; for each width, (rows, positions, filters)."""
        out = []
        for w, t in zip(self.widths, self.tables, strict=True):
            n = x.shape[1] - w + 1
            r = t[0].take(x[:, :n], axis=0)
            for j in range(1, w):
                r += t[j].take(x[:, j : j + n], axis=0)
            out.append(r)
        return out

    def softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, languages) of windows."""
        out = []
        for a in range(0, len(x), 256):  # bounded memory
            top = [r.max(axis=1) for r in self.responses(x[a : a + 256])]
            out.append(self.softmax(np.maximum(np.concatenate(top, axis=1) + self.bias, 0)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
        """Adam on cross-entropy; the maximum passes its gradient to the winning position alone."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.dense, self.offset]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                xb, yb, n = x[rows], y[rows], len(rows)
                responses = self.responses(xb)
                best = [r.argmax(axis=1) for r in responses]
                top = np.concatenate([np.take_along_axis(r, b[:, None], axis=1)[:, 0] for r, b in zip(responses, best, strict=True)], axis=1)
                h = np.maximum(top + self.bias, 0)
                dz = self.softmax(h)
                dz[np.arange(n), yb] -= 1
                dz /= n
                dh = (dz @ self.dense.T) * (h > 0)
                grads = []
                for k, (w, b) in enumerate(zip(self.widths, best, strict=True)):
                    g, own = np.zeros_like(self.tables[k]), dh[:, k * self.filters : (k + 1) * self.filters]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, b + j, axis=1), np.arange(self.filters)[None]), own)
                    grads.append(g)
                grads += [dh.sum(0), h.T @ dz + 1e-4 * self.dense, dz.sum(0)]
                step += 1
                for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
        return self


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, window) of all texts, zero-padded; the text of each; the bytes in each."""
    size = ends - starts
    per = -(-size // window)
    owner = np.repeat(np.arange(len(size)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = starts[owner] + number * window
    filled = np.minimum(window, ends[owner] - at)
    x = np.zeros((len(owner), window), np.uint8)
    for k in range(len(owner)):
        x[k, : filled[k]] = data[at[k] : at[k] + filled[k]]
    return FOLD[x], owner, filled


def fit(docs: DataFrame, learn: F.Column | None = None, per_language: int = 600, windows_per_text: int = 2, window: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCnn | None:
    """Trained on at most ``per_language`` texts of each language; None without any."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.filter("learn and lang is not null and octet_length(text) > 0")
    some = bounded_sample(rows.select("id", "lang").distinct(), "lang", "id", per_language)
    rows = rows.join(F.broadcast(some), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))  # at most per_language rows of each language

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, bytes]] = []
            for doc, text, lang in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "lang")), strict=True):
                raw = text.encode()
                rng = np.random.default_rng(abs(doc))
                for at in {0, *(rng.integers(0, max(1, len(raw) - window + 1), windows_per_text - 1)).tolist()}:
                    out.append((doc, lang, raw[at : at + window].ljust(window, b"\0")))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.binary())], names=["id", "lang", "window"])

    got = sorted({tuple(r) for r in rows.mapInArrow(windows, "id long, lang string, window binary").collect()})
    if not got:
        return None
    languages = sorted({r[1] for r in got})
    x = FOLD[np.frombuffer(b"".join(bytes(r[2]) for r in got), np.uint8).reshape(len(got), window)]
    return ByteCnn(languages, window=window).fit(x, np.array([languages.index(r[1]) for r in got]))


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain_letter = re.compile(r"[A-Za-z]").search
        for batch in batches:
            names, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            data, starts, ends = text_bytes(batch.column(1))
            for a, b in slices(starts, ends, 1 << 20) if model is not None else ():
                x, owner, filled = cut(data, starts[a:b], ends[a:b], model.window)
                p = model.predict(x) * filled[:, None]
                total = np.zeros((b - a, len(model.languages)))
                np.add.at(total, owner, p)
                total /= np.maximum(1, ends[a:b] - starts[a:b])[:, None]
                texts = batch.column(1).slice(a, b - a).to_pylist()
                known = np.array([bool(t and (plain_letter(t) or any(map(str.isalpha, t)))) for t in texts], bool)
                names[a:b][known] = np.array(model.languages, dtype=object)[total.argmax(axis=1)][known]
                scores[a:b][known] = np.clip(total.max(axis=1)[known], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs, learn=~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
