"""Memory of tasks: those that look for near copies, those that score toxicity, and batches of the pipeline."""

import pickle
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa

from tidelens.llm import ngram_join, toxicity
from tidelens.llm.common import text_bytes
from tidelens.llm.shingles import Shingler


def test_counting_shingles_is_small():
    """A task counts in a byte for each bucket, up to 255; texts are cut into shingles a bounded number of bytes at a time."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 15_000)) for _ in range(40)] + ["a b c d e"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["row", "text", "doc_id"])

    class Docs:
        def mapInArrow(self, run, schema):
            return list(run(iter([batch])))

    how = ngram_join.Settings()
    tracemalloc.start()
    got = ngram_join.measured(Docs(), how)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6
    counts = np.zeros((ngram_join.PARTS, (1 << how.buckets_log2) // ngram_join.PARTS), np.int64)
    for part, packed in zip(got[-1].column(4).to_pylist(), got[-1].column(5).to_pylist(), strict=True):
        ngram_join.add_counts(counts[part], packed)
    data, starts, ends = text_bytes(batch.column(1))
    every = np.concatenate([(s >> np.uint64(64 - how.buckets_log2)).astype(np.int64) for s in Shingler(how.words)(data, starts, ends)])
    assert (counts.reshape(-1) == np.minimum(np.bincount(every, minlength=counts.size), 255)).all() and counts.max() == 255


def test_toxicity_index_is_small():
    """A worker's index is loaded and asked in parts; the frequent terms are held once in full, in single precision."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60_000)]
    terms = lambda: {words[k]: int(n) for k, n in zip(np.unique(np.r_[rng.integers(0, 400, 60), rng.integers(400, 60_000, 240)]), rng.integers(1, 4, 300), strict=False)}
    stored = pickle.dumps(toxicity.BlockMaxIndex([(k, k % 2, terms()) for k in range(3000)], words))
    queries = [terms() for _ in range(64)]
    tracemalloc.start()
    index = pickle.loads(stored)
    held, loading = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    vectors = [index.vector(tf) for tf in queries]
    got = index.nearest_of(vectors, 15)
    asking = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert loading < 45e6 and asking < 45e6
    for (at, w), (found, similarity) in zip(vectors[:5], got[:5], strict=True):
        q = np.zeros(len(words))
        q[at] = w
        every = np.array([w @ q[t] for t, w in index.vectors])
        order = np.lexsort((np.arange(len(every)), -np.round(every, 12)))[:15]
        assert (found == order).all() and np.allclose(similarity, every[order], atol=1e-11)


def test_stages_ask_for_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for first, then in ((10_000, 1000), (0, 1000), (200, 200)):
            spark.conf.set(name, first)
            docs = spark.range(3000).repartition(1).selectExpr("id as doc_id", "'x' as text")
            corpus_pipeline.redact_personal(spark, docs, "")
            sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
            assert max(r.n for r in sizes.collect()) == then
    finally:
        spark.conf.set(name, before)


def test_asks_leave_in_small_batches():
    """An ask goes to every leaf that it may need; what leaves a task at once doesn't grow with asks times leaves."""
    from tidelens.llm import negatives as ng

    class Table:
        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(4000, 32)))
    sample = ng.Sample.__new__(ng.Sample)
    sample.x, sample.no, sample.label, sample.tree = x, np.arange(4000), np.arange(4000) % 10, ng.Gnat(x, 8)
    sample.tree.widen(x)
    asks = [pa.array(sample.no), pa.array(sample.label), pa.array(list(x), pa.list_(pa.float64()))]
    scores = pa.array([[1.0, 5.0e5], [2.0]] * 2000, pa.list_(pa.float64()))
    for percent, columns in ((None, asks), (80, [*asks, scores])):
        batch = pa.RecordBatch.from_arrays(columns, names=["no", "label", "vec", "scores"][: len(columns)])
        sizes, rows, seen = [], 0, set()
        for out in ng.asking(Table(), sample, np.float32, 5, percent)(iter([batch.slice(0, 1500), batch.slice(1500)])):
            sizes.append(out.nbytes)
            rows += out.num_rows
            seen |= set(out.column("no").to_pylist())
        assert rows > 100_000 and seen == set(range(4000)), (rows, len(seen))
        assert max(sizes) < 8 << 20
