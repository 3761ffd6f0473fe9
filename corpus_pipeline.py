"""The corpus pipeline: documents in, packed training sequences out. Each stage is one operator of tidelens.llm.

Defined cases: rows with a null or empty text pass all stages (the last gives them one piece, the end id), as do rows
without id; rows that repeat id and text count as copies, of which one stays, and rows that repeat an id with unlike
texts all stay; without labels or benchmark items those stages keep all; an empty table gives no rows; all stages but the
last keep the columns of their input, extra ones included, and ``personal`` sets ``n_chars`` anew where it changes a text.

Each stage lets the session's Arrow batches have 1,000 rows at most (``common.small_batches``); the setting stays, since what
a stage returns is computed later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelens.functions import storage
from tidelens.llm import decontaminate, ngram_join, packing, personal, toxicity
from tidelens.llm.common import materialise, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out()), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that word shingles link at a Jaccard similarity of 0.75 or more."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    small_batches(spark)
    return personal.redact(docs, personal.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, packing.tokenizer_path(), added_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("personal", redact_personal),
    ("packing", pack),
]

#: The stages learn models, match edits and tokenise: beyond SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage. Each stage's input, and what it wrote on the way, goes once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with storage.scratch(spark) as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}", instead_of=docs if k else None))
    return STAGES[-1][1](spark, docs, sf_dir)
