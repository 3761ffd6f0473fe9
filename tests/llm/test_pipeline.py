"""Each stage of the pipeline on its own input, and the whole run."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_queries import plain_scores
from test_small_cases import components_of, plain_distance
from tokenizers import Tokenizer

from tidelens.llm import decontaminate, packing, personal
from tidelens.llm.common import materialise, table


def test_stages(spark, tables):
    docs, names = table(spark, tables, "documents"), table(spark, tables, "documents").columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, tables), name)
        assert out.columns == names
        after = out.count()
        assert 0.8 * before * 0.8 < after <= before
        if name == "decontaminate":
            assert decontaminate.matches(out, table(spark, tables, "benchmark")).count() == 0
        if name == "personal":
            assert out.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0
        docs, before = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    ends = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m"))
    assert ends.filter("n <> m").count() == 0 and ends.count() == before


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 0


def test_one_of_each_group_stays(spark):
    same = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(3, same), (1, same), (2, same.upper()), (4, "other words entirely here now")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, d, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, same), (4, "other words entirely here now")]
    assert re.match(r"\w", kept[0].text)


def fixture_rows():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 8)))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words, n))
    item = prose(14)
    texts = [prose(int(rng.integers(20, 60))) for _ in range(60)]
    texts += [f"you {bad} moron idiot {prose(12)}" for bad in ("damn", "vile", "foul") for _ in range(10)]
    texts += [t + " and more" for t in texts[:8]] + [texts[3].upper(), texts[3]]
    texts += [f"{prose(10)} {item} {prose(10)}", f"{prose(10)} {item.upper().replace('a', 'x', 1)}", f"mail {words[0]}@example.org or 10.0.0.7 {prose(9)}", f"card 4111 1111 1111 1111 {prose(9)}"]
    texts += [None, "", "  \n", "short", prose(3000)]
    rows = [(k, t, "en", "s", len(t or ""), k % 3, f"k{k}", 0.5) for k, t in enumerate(texts)]
    labels = [(k, 1, int(60 <= k < 90)) for k in range(0, 90) if k % 7] + [(5, 1, None)]
    return rows, labels, [(0, item), (1, prose(15)), (2, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, score double"


def test_run_against_a_plain_version(spark, tmp_path):
    """Nulls, empty texts, copies, benchmark passages, personal data and columns whose names clash, stage by stage."""
    rows, labels, items = fixture_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {r[0]: r[1] for r in rows}
    scores = plain_scores(list(docs.items()), [(i, toxic) for i, _, toxic in labels])
    kept = {i: t for i, t in docs.items() if scores[i] < 0.3}
    assert not set(range(60, 90)) & set(kept) and set(range(60)) <= set(kept)
    groups = components_of(list(kept.values()), list(kept))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    known = [decontaminate.normal(t) for _, t in items if t]
    kept = {i: t for i, t in kept.items() if not t or len(t) > 5000 or all(plain_distance(p, decontaminate.normal(t)) > int(0.06 * len(p)) for p in known)}
    finder, counts = personal.Finder(), Counter()
    for t in kept.values():
        counts.update(p for _, p in finder.candidates(t or "", finder.base(t or "")))
    weights, want = personal.train(counts), {}
    library = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in kept.items():
        base = finder.base(t or "")
        spans = sorted({*base, *[s for s, _ in personal.accepted(finder, t or "", base, weights, {}, 0.5)]}, key=lambda s: (s[1], -s[2]))
        out, last = "", 0
        for kind, a, b in spans:
            if a >= last:
                out += (t or "")[last:a] + f"<{kind}>"
            last = max(last, b)
        want[i] = np.array([*library.encode(out + (t or "")[last:], add_special_tokens=False).ids, 0], "<u4")
    found = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        found.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(found) == set(want)
    for i, pieces in found.items():
        assert [s for s, _ in sorted(pieces)] == list(np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1]) and sum(n for _, n in pieces) == len(want[i])


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    rows, labels, items = fixture_rows()
    spark.createDataFrame(labels[:0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items[:0], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part in (rows[:0], rows[-5:]):
        docs = spark.createDataFrame(part, SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialise(stage(spark, docs, str(tmp_path)), name)
            assert out.columns == docs.columns and out.count() == len(part)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert pieces.select("doc_id").distinct().count() == len(part)
