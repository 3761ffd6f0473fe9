"""Packing: best-fit decreasing over a segment tree indexed by remaining capacity.

``tokenise`` cuts every document's ids (with an end id) into full windows and one remainder; ``pack`` deals the
pieces, which are small rows without ids, to groups of bounded size and packs each group: a full window is a
sequence of its own, remainders go, longest first, to the open window with the least room that still holds them.
Only piece lengths are shuffled; pieces are written before, since a piece's group depends on its place in its task. The
padding is what best fit leaves open; a group holds about ``group_rows``
documents, so a group never grows with the input and the loss at the ends of groups stays a fraction of a percent.

Defined cases: null text counts as empty (one piece: the end id); null ids stay null; repeated rows are packed as often as they occur;
documents of any length are cut; columns other than the id and the text are ignored; an empty table gives no rows;
equal lengths are taken in the order of (document id, start), equal windows by the lower number.
"""

from __future__ import annotations

import re

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean, materialise, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What the tokenizer splits a text into before it merges; the fixed pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin letters and ASCII only, where the standard library's faster classes mean the same.
LATIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_LATIN = r"[^\t\n\r -~\u00c0-\u024f]"


class Ids(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; the ids of words met before are kept, up to ``most``.

    A byte-level BPE merges only within the words that its pattern cuts, so the ids of a text are those of its words
    one after the other. The vocabulary of the tokenizer file gives the ranks of the merges.
    """

    def __init__(self, tokenizer_path: str, most: int = 100_000, added_tokens: bool = False):
        import regex
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_file(tokenizer_path)
        vocabulary = library.get_vocab(with_added_tokens=False)
        added = {t.content: (i, t) for i, t in library.get_added_tokens_decoder().items()} if added_tokens else {}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that take in blanks or need whole words are not supported")
        self.added = {content: np.array([i], dtype="<u4").tobytes() for content, (i, _) in added.items()}
        longest_first = "|".join(re.escape(content) for content in sorted(added, key=len, reverse=True))
        self.cut = re.compile(f"({longest_first})").split if added else None
        shown = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
        plain = [b for b in range(256) if chr(b) in set(shown)]
        rest = iter(sorted((c for c in shown if ord(c) > 255), key=ord))
        byte_of = {chr(b): b for b in plain} | {next(rest): b for b in range(256) if b not in set(plain)}
        special = {"<|endoftext|>"}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.merge = tiktoken.Encoding("of-file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words, self.latin_words, self.odd = regex.compile(WORDS).findall, re.compile(LATIN_WORDS).findall, re.compile(NOT_LATIN).search
        self.most = most

    def __missing__(self, word: str) -> bytes:
        got = array("I", self.merge(word)).tobytes()
        if len(word) <= 64:
            self[word] = got
        return got

    def of(self, text: str) -> bytes:
        """The ids of a text: those of its added tokens, if they count, and of what lies between them."""
        if self.cut is None or not any(content in text for content in self.added):
            return self.between(text)
        return b"".join(self.added[part] if k % 2 else self.between(part) for k, part in enumerate(self.cut(text)))

    def between(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        return b"".join(map(self.__getitem__, (self.words if self.odd(text) else self.latin_words)(text)))


def tokenise(docs: DataFrame, tokenizer_path: str, groups: int, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece: full windows of ``window`` ids, then the remainder; ``bucket`` deals them to ``groups``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, count = Ids(tokenizer_path, added_tokens=added_tokens), np.array([end_id], dtype="<u4").tobytes(), 0
        give_back()  # what reading the tokenizer file took
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids), 256):
                for doc, text in zip(ids[a : a + 256], texts.slice(a, 256).to_pylist(), strict=True):
                    got = ids_of.of(text or "") + end
                    total = len(got) // 4
                    for start in range(0, total, window):
                        piece = got[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, (zlib.crc32(str(doc).encode()) + count) % groups))
                    count += 1
                if len(rows) > 50_000 or a + 256 >= len(ids):
                    cols = list(zip(*rows, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"])
                    rows = []

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), PIECES)


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each length, taken in the given order (decreasing).

    ``tree`` is a segment tree over remaining capacities 0..window: a node counts the open windows below it, so the
    tightest window with room for ``n`` is the first non-empty leaf at or after ``n``.
    """
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    where, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0

    def add(room: int, by: int) -> None:
        at = room + size
        while at:
            tree[at] += by
            at >>= 1

    def first_from(n: int) -> int:
        at = n + size
        if tree[at]:
            return n
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < size:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - size
            at >>= 1
        return -1

    for k, n in enumerate(map(int, lengths)):
        room = first_from(n)
        if room < 0:
            slot, room, used = used, window, used + 1
        else:
            slot = open_at[room].pop()
            add(room, -1)
        where[k], offset[k] = slot, window - room
        if room > n:
            open_at[room - n].append(slot)
            add(room - n, 1)
    return where, offset


def pack(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """Sequences of at most ``window`` ids; sequence_id is bucket * 2^32 + number within the bucket."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        where, offset = best_fit(pdf["length"].to_numpy(), window)
        return pdf.drop(columns="bucket").assign(sequence_id=int(key[0]) * (1 << 32) + where, offset=offset)

    return pieces.groupBy("bucket").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, group_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """``added_tokens``: a literal added token (<|endoftext|>) in a text gets its one id, as by default in `tokenizers`;
    without it, the ids of its characters. The query and the pipeline set it."""
    groups = max(1, -(-docs.count() // group_rows))
    pieces = tokenise(docs, tokenizer_path, groups, window, end_id, id_col, text_col, added_tokens)
    return pack(materialise(pieces, "pieces"), window)  # written, so a repeated task finds every piece in its group again


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)
