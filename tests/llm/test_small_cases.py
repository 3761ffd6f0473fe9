"""Defined results of the training-data operators for nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns, each against a plain version."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import decontaminate, language, neighbours, ngram_join, packing, personal, sharding, toxicity, urls, warc
from tidelens.llm.common import table
from tidelens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, n long, id long"


def docs(spark, texts, start=0):
    rows = [(start + k, t, ("en", "fr")[k % 2], "s", len(t or ""), 1, 2, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "alpha beta gamma delta epsilon " * 3000


# Chunked records


def test_warc(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\n", None), (4, "u", ""), (5, "u", LONG * 3), (5, "u", LONG * 3), (7, "u", "é")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.archive(pages, chunk_bytes=1000)
    got = {}
    for r in warc.record_digests(manifest, chunk_bytes=777).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    for page, _, html in rows:
        body = (html or "").encode()
        newest = max(p for p, _, h in rows if (h or "") == (html or ""))
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if page == newest else "revisit", None if page == newest else newest)
        assert set(got[page]) == {want}
    assert len(got[5]) == 2
    chunks = warc.read_chunks(manifest, chunk_bytes=777).filter("page_id = 5").collect()
    one = chunks[0].record_id
    parts = sorted((c for c in chunks if c.record_id == one), key=lambda c: c.chunk_no)
    assert max(len(c.data) for c in parts) <= 777 and b"".join(bytes(c.data) for c in parts) == (LONG * 3).encode()
    running = hashlib.sha1()
    for c in parts:
        running.update(bytes(c.data))
        assert c.digest_so_far == base64.b32encode(running.digest()).decode()
    small = warc.record_digests(warc.archive(pages, revisit_bytes=2)).filter("page_id in (1, 2)").collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.record_digests(warc.archive(pages.limit(0))).count() == 0


# Approximate neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8))
    x[40:140] = x[40]  # a vector that a third of the rows share
    rows = [(k, [float(v) for v in r], 0, 1) for k, r in enumerate(x)]
    rows += [(900, None, 0, 1), (901, [0.0] * 8, 0, 1), (902, [float("nan")] + [1.0] * 7, 0, 1), (903, [None] + [1.0] * 7, 0, 1), (904, [1.0], 0, 1), (5, [float(v) for v in x[5]], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, class_id int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 10 == 0, k=20, block_rows=50, target=1.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 300, 10))
    for q, ranks in got.items():
        s = np.round(x @ x[q], 12)
        order = [k for k in np.lexsort((np.arange(300), -s)) if k != q][:20]
        assert [ranks[k + 1][0] for k in range(20)] == order
        assert all(abs(ranks[k + 1][1] - x[order[k]] @ x[q]) < 1e-9 for k in range(20))
    few = neighbours.search(df.filter("vec_id < 4"), F.lit(True), k=20).collect()
    assert len(few) == 12
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(df.filter("vec_id in (900, 901)"), F.lit(True)).count() == 0


def test_neighbours_of_small_lists(spark):
    """Queries in small lists get k rows, too, when large clusters decide the number of lists to probe."""
    rng = np.random.default_rng(5)
    sizes = [600] * 5 + [6] * 30
    centres = rng.standard_normal((len(sizes), 16)) * 6
    x = np.concatenate([c + rng.standard_normal((n, 16)) * 0.3 for c, n in zip(centres, sizes, strict=True)])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.query_id: r.n for r in neighbours.search(df, F.col("vec_id") >= 3000, k=20).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 180 and set(got.values()) == {20}


def test_codes_choose_what_is_reranked(spark):
    """Lists follow the square root of the rows, codes drop most of them, near copies are told apart, recall holds."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32)) * 2
    x = np.concatenate([centres[rng.integers(0, 40, 2500)] + rng.standard_normal((2500, 32)) * 0.5, centres[0] + rng.standard_normal((1500, 32)) * 0.01])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    model = neighbours.train(neighbours.classes(df, "vec_id", "embedding", 21), k=20)
    assert len(model.centre) == 64 and model.probes <= 21  # at most a third of the lists
    own = model.assign(x)
    lists = np.argsort(-(x[4:5] @ model.centre.T))[0, : model.probes]
    near = np.concatenate([model.approximate(x[4:5], i, model.encode(x[own == i], own[own == i]))[0] for i in lists])
    assert np.allclose(near, np.concatenate([model.decode(model.encode(x[own == i], own[own == i]), np.full((own == i).sum(), i)) @ x[4] for i in lists]), atol=1e-3)
    assert len(near) > 168  # so the codes decide which 168 rows are reranked
    got, found = {}, 0
    for r in neighbours.search(df, F.col("vec_id") % 40 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(ids) & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert len(got) == 100 and all(len(v) == 20 for v in got.values()) and found / 2000 >= 0.9


@pytest.mark.parametrize("kind", ["prime dimension", "many dimensions", "few long vectors", "one tight group"])
def test_neighbours_of_other_rows(spark, kind):
    """Recall holds where the dimension has no divisor, where it is large, where the sample has few of the vectors that are
    nearest to all, and where one group has more rows than are reranked at first."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, {"prime dimension": 37, "many dimensions": 256}.get(kind, 24)))
    if kind == "few long vectors":
        x[rng.choice(3000, 30, replace=False)] *= 50
    if kind == "one tight group":
        x[:1000] = x[0] + 1e-5 * x[:1000]
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got, found = {}, 0
    for r in neighbours.search(df, F.col("vec_id") % 60 == 0, k=20, train_rows=1000).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(ids) & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert len(got) == 50 and all(len(v) == 20 for v in got.values()) and found / 1000 >= 0.95


def test_neighbours_recall(spark, tables):
    got = neighbours.op2_neighbours(spark, tables).toPandas()
    e = table(spark, tables, "embeddings").toPandas().sort_values("vec_id")
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    found = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        near = set(ids[np.lexsort((ids, -s))[:20]])
        found, total = found + len(near & set(got[got.query_id == q].vec_id)), total + 20
    assert found / total >= 0.9


# Toxicity


def test_toxicity_is_exact_search():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(30)]
    examples = [(k, int(rng.random() < 0.3), {words[j]: int(rng.integers(1, 4)) for j in rng.choice(30, 5, replace=False)}) for k in range(400)]
    index = toxicity.BlockMaxIndex(examples, words, block=16)
    dense = np.zeros((400, 30))
    for k, (terms, weights) in enumerate(index.vectors):
        dense[k, terms] = weights
    for _ in range(50):
        terms, weights = index.vector({words[j]: 1 for j in rng.choice(30, 4, replace=False)})
        q = np.zeros(30)
        q[terms] = weights
        s = np.round(dense @ q, 12)
        order = [k for k in np.lexsort((np.arange(400), -s))[:15] if s[k] > 0]
        found, similarity = index.nearest(terms, weights, 15)
        assert found.tolist() == order and np.allclose(similarity, np.minimum(1, s[order]))


def test_toxicity(spark):
    texts = ["a quiet day number %d in town" % k for k in range(60)] + ["you idiot moron number %d in town" % k for k in range(20)] + [None, "", LONG + " idiot moron"]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(k, 0, 0 if k < 60 else 1) for k in range(80)] + [(3, 0, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels, least_chi_square=10)
    got = {r.doc_id: r for r in toxicity.score(d.union(d.limit(1)), model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 83
    assert got[82].score >= 0.3 and got[70].score >= 0.3 and got[5].score < 0.3 and got[80].score == got[81].score < 0.3
    assert got[70].neighbours[0].toxic == 1
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(60)) | {80, 81}
    assert {r.doc_id for r in toxicity.keep_clean(d, model, most_log2=8).collect()} == set(range(60)) | {80, 81}
    assert toxicity.fit(d, labels.limit(0)) is None and toxicity.score(d, None).filter("score <> 0").count() == 0
    assert toxicity.score(d.limit(0), model).count() == 0


def test_toxicity_words_are_those_of_the_pattern():
    every = [between.join(map(chr, range(c, c + 64))) for c in range(0, 0x110000, 64) for between in ("", "A", " ")]
    every += ["", "ΑΣ ΑΣ, İI", "É b2c_d" * 200_000]
    assert all(toxicity.term_counts(t) == Counter(re.findall(toxicity.WORD, t.lower())) for t in every)


def test_toxicity_counts_words_in_less_time_than_the_pattern():
    """Two passes of op3 count the words of all texts; most of that was the pattern's own time."""
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]
    texts = [", ".join(rng.choice(words, 400)) + ("" if k % 2 else " é 12_3") for k in range(200)]

    def seconds(count):
        took = []
        for _ in range(7):
            began = time.thread_time()
            for text in texts:
                count(text)
            took.append(time.thread_time() - began)
        return min(took)

    assert seconds(toxicity.term_counts) < 0.8 * seconds(lambda text: Counter(re.findall(toxicity.WORD, text.lower())))


def test_toxicity_uses_all_words(spark):
    """Copies of a long text do not displace the words that mark toxicity, and all words of all documents count."""
    long = " ".join("".join(chr(97 + int(c)) for c in f"{k:04d}") + "x" for k in range(1500))
    texts = [long] * 120 + ["calm %s day in town" % "abcdefghij"[k % 10] * (1 + k // 10) for k in range(60)] + ["%s moron town" % ("klmnopqrst"[k % 10] * (1 + k // 10)) for k in range(40)]
    texts += ["what a moron", "calm unseenword day unseenword otherword", "calm"]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(k, 0, int(k >= 180)) for k in range(220)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    assert (model.index.ids < 120).sum() == 1 and "moron" in model.index.term and len(model.index.term) > 1500
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert got[220].score >= 0.3 and got[220].neighbours[0].toxic == 1 and got[0].score < 0.3
    words = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts]
    df = Counter(w for x in words for w in set(x))

    def vector(x):
        plain = {w: (1 + np.log(x.count(w))) * (np.log((1 + len(texts)) / (1 + df[w])) + 1) for w in set(x)}
        return {w: v * (model.index.weight[k] / model.index.idf[k] if (k := model.index.term.get(w)) is not None else 1) for w, v in plain.items()}

    for doc in (220, 221, 222):
        q, near = vector(words[doc]), {r.example_id: r.similarity for r in got[doc].neighbours}
        assert near
        for i, similarity in near.items():
            e = vector(words[i])
            cosine = sum(v * e.get(w, 0) for w, v in q.items()) / np.sqrt(sum(v * v for v in q.values()) * sum(v * v for v in e.values()))
            assert abs(cosine - similarity) < 1e-9


# N-gram join


def components_of(texts, ids):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, label = [shingles(t) for t in texts], list(ids)
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    label = [low if x in (label[a], label[b]) else x for x in label]
                    changed = True
    return {i: (len(s), x) for i, s, x in zip(ids, sets, label, strict=True)}


def near_texts():
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 150))))
        texts.append(" ".join(base))
        for _ in range(5):
            other = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 12))):
                other[int(rng.integers(len(other)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(other))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(1, 40)))) for _ in range(25)]
    return texts + [None, "", " \t\n", "one", "ONE ", "two words", "two  Words", LONG, LONG.upper(), "É é", "é é"]


@pytest.mark.parametrize(("block", "bitmap_log2"), [(8192, 27), (7, 8)])
def test_ngram_join(spark, block, bitmap_log2):
    texts = near_texts()
    how = ngram_join.Settings(block=block, leaf=4, leaders=2, bitmap_log2=bitmap_log2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, texts).repartition(5), how).collect()}
    assert got == components_of(texts, list(range(len(texts))))


def test_repeated_ids(spark):
    """Rows that share an id keep their links, and no text is lost."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near = lambda t, k: t + f" tail{k}"
    rows = [(5, a), (5, b), (7, near(a, 1)), (9, near(b, 1)), (11, near(a, 2)), (13, near(b, 2)), (5, b), (2, "alone in the world with no copy"), (5, ""), (None, a), (None, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(d).collect()}
    assert got == {(5, 56, 5), (7, 57, 5), (9, 57, 5), (11, 57, 5), (13, 57, 5), (2, 3, 2), (5, 0, 5), (None, 56, 5)}
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(d).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (2, rows[7][1]), (5, ""), (None, a), (None, a)], key=str)


def test_keep_one(spark):
    texts = near_texts()
    d = docs(spark, texts)
    want = {i for i, (_, c) in components_of(texts, list(range(len(texts)))).items() if i == c}
    kept = ngram_join.keep_one(d.union(d.filter("doc_id < 3")))
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(want)
    assert ngram_join.join(d.limit(0)).count() == 0 and ngram_join.keep_one(d.limit(0)).count() == 0
    nameless = docs(spark, ["some words without an id here"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert ngram_join.keep_one(nameless.union(nameless)).count() == 2


def test_count_tree_finds_all():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(1, 120))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(150)]
    sets += [s[: max(1, len(s) * 9 // 10)] for s in sets]
    how = ngram_join.Settings(leaf=5)
    fine = [ngram_join.counts_of(ngram_join.count_vector(s, how)) for s in sets]
    n = np.array([len(s) for s in sets])
    found = list(ngram_join.tree_pairs(np.arange(300), n, fine, np.arange(300), how))
    assert len(found) == len(set(found))
    for a in range(300):
        for b in range(a + 1, 300):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both / (n[a] + n[b] - both) >= 0.75:
                assert (a, b) in found


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 140))


# Personal data


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and personal.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


TEXTS = ["a@b@c.d e@f.g@h.i ..@x.y", "@a.b x@@y.z q@w.e.r.@m.n é@x.yz", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "+1 (234) 567-8901 x", "4111 1111 1111 1111 and 4111-1111-1111-1112", "", "no data", 'key = "abcdef0123456789abcdef0123456789"', "call 555-123-4567 now", "joe [at] example [dot] org", "a" * 5000 + "@", "1" * 5000 + ".2.3.4"]


def test_base_spans():
    finder = personal.Finder()
    for t in TEXTS[:-1]:
        assert sorted(finder.base(t)) == sorted(plain_spans(t))
    assert finder.base(TEXTS[-1]) == []


def test_personal(spark):
    texts = [*TEXTS, None, LONG + " me@example.org", "é me@example.org"] + ['token = "%032x"' % (k * 0x123456789ABCDEF0123456789ABCDEF % (1 << 128)) for k in range(20)]
    d = docs(spark, texts)
    weights = personal.fit(d)
    got = {r.doc_id: r for r in personal.find(d, weights).collect()}
    assert len(got) == len(texts) and got[12].base == [] == got[12].added
    assert [(s.kind, s.start, s.end) for s in got[14].base] == [("email", 2, 16)]
    assert [s.kind for s in got[20].added] == ["secret"] and [s.kind for s in got[7].added] == ["secret"]
    red = {r.doc_id: r for r in personal.redact(d, weights).collect()}
    assert red[14].text == "é <email>" and red[14].n_chars == len("é <email>") and red[12].text is None
    assert red[20].text == 'token = "<secret>"' and personal.redact(d, weights).columns == d.columns
    assert personal.find(d.limit(0), personal.fit(d.limit(0))).count() == 0


# URL filter


def test_urls(spark):
    rows = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/?q", "http://x.net/es/", "http://x.net/en/", "http://x.com", "nothing", None, "a://b.net/fr/#f", "x://ecom/", "http://u@h.org:80/p?a=1&b=2"]
    pages = spark.createDataFrame([(k, u, "", 1.0) for k, u in enumerate(rows * 6)], "page_id long, url string, rule string, length double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert len(got) == len(rows) * 6
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4][2] is None and got[5][:3] == ("x.com", "", None) and got[6][:3] == ("", "", None) == got[7][:3]
    assert got[8][2:] == ("net/fr/", "block") and got[9][2] is None and got[10][:2] == ("u@h.org:80", "/p")
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    only = urls.judge(pages.filter("page_id = 4")).collect()
    assert [r.verdict for r in only] == ["allow"]
    assert urls.judge(pages.limit(0)).count() == 0


# Decontamination


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for k in range(1, len(p) + 1):
        new = [k] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p[k - 1] != t[j - 1]))
        row = new
    return min(row)


def test_decontaminate(spark):
    rng = np.random.default_rng(4)
    letters = list("abcde ")
    items = [decontaminate.normal("".join(rng.choice(letters, 60))) for _ in range(8)] + ["ab", ""]
    texts = []
    for k in range(40):
        t = "".join(rng.choice(letters, 200))
        if k % 2:
            item = list(items[k % 8])
            for _ in range(k % 5):
                item[int(rng.integers(len(item)))] = str(rng.choice(letters))
            t = t[:100] + "".join(item).upper().replace(" ", " \n ") + t[100:]
        texts.append(t)
    texts += [None, "", items[0], LONG + items[1]]
    d, b = docs(spark, texts), spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(d, b, error_rate=0.06, block_chars=150).collect()}
    want = {}
    for k, t in enumerate(texts[:-1]):
        for i, item in enumerate(items):
            if item and t:
                distance = plain_distance(item, decontaminate.normal(t))
                if distance <= int(0.06 * len(item)):
                    want[(k, i)] = distance
    assert {k: v for k, v in got.items() if k[0] != len(texts) - 1} == want
    assert got[(len(texts) - 1, 1)] == 0
    kept = decontaminate.clean(d, b, block_chars=150)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k for k, _ in got}
    assert decontaminate.matches(d, b.limit(0)).count() == 0 and decontaminate.clean(d.limit(0), b).count() == 0
    one = decontaminate.matches(docs(spark, ["xx  " + items[2].upper() + "!"]), b.filter("item_id = 2")).first()
    assert (one.distance, one.start, one.end) == (0, 4, 4 + len(items[2]))


# Language


def test_language(spark):
    english, french = "the cat and the dog went over the hill ", "le chat et le chien vont sur la colline "
    texts = [(english if k % 2 == 0 else french) * (1 + k % 3) + str(k) for k in range(120)] + [None, "", "123 ...", english * 500]
    d = docs(spark, texts)
    model = language.fit(d.filter("doc_id < 120"))
    got = {r.doc_id: r for r in language.predict(d.union(d.limit(1)), model).collect()}
    assert sum(got[k].lang_pred == ("en", "fr")[k % 2] for k in range(120)) >= 118
    assert {got[k].lang_pred for k in (120, 121, 122)} == {"und"} and got[123].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.fit(d.limit(0)) is None and {r.lang_pred for r in language.predict(d, None).collect()} == {"und"}
    assert language.predict(d.limit(0), model).count() == 0


def test_language_held_out(spark, tables):
    got = language.op8_language(spark, tables).join(table(spark, tables, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95


def test_network_fits_a_tiny_sample():
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 103, (6, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 0, 1])
    model = language.ByteCnn(["a", "b"], widths=(2, 3), filters=3, window=12).fit(x, y, epochs=60, batch=6)
    assert (model.predict(x).argmax(axis=1) == y).mean() >= 5 / 6


# Sharding


def test_sharding(spark):
    texts = ["x" * (k % 50) for k in range(300)] + ["hot" * 40] * 150 + [None, "", LONG]
    got = sharding.shard(docs(spark, texts).repartition(4)).toPandas()
    assert len(got) == len(texts) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    rest = got[got["size"] < 1000].groupby("shard")["size"].sum()
    mean = got["size"].sum() / 24
    even = sharding.shard(docs(spark, texts[:-1])).toPandas().groupby("shard")["size"].sum()
    assert len(even) == 24 and even.max() - even.min() <= 2 * 128 + 2 and rest.max() <= mean + 2 * 128
    same = spark.createDataFrame([(1, "t")] * 100, "doc_id long, text string")
    repeated = sharding.shard(same).groupBy("shard").count().collect()
    assert len(repeated) == 24 and max(r["count"] for r in repeated) <= 5
    assert sharding.shard(docs(spark, texts).limit(0)).count() == 0
    assert sharding.shard(docs(spark, ["a"])).count() == 1


# Packing


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = ["hello world", None, "", LONG, "²½ x́é 中文 \x1c\x85 <|endoftext|>", "a " * 1023, "hello world"]
    d = docs(spark, texts)
    got = packing.pack_documents(d.union(d.limit(1)), packing.tokenizer_path()).toPandas()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    plain.encode_special_tokens = True
    for k, t in enumerate(texts):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = got[got.doc_id == k].sort_values("start")
        times = 2 if k == 0 else 1
        assert own.length.sum() == times * len(ids) and set(own.doc_tokens) == {len(ids)}
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 1024 and (g.offset == g.length.cumsum() - g.length).all()
    assert packing.pack_documents(d.limit(0), packing.tokenizer_path()).count() == 0


def test_packing_added_tokens(spark, tmp_path):
    """The query's ids are those of `tokenizers` in its default mode."""
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|>  \n y<|endoftext|", "no such token "]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op10_packing(spark, str(tmp_path)).toPandas()
    library = Tokenizer.from_file(packing.tokenizer_path())
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == k]
        assert own.doc_tokens.tolist() == [len(ids)] and own.ids_crc32.tolist() == [zlib.crc32(ids.tobytes())]


def test_best_fit():
    rng = np.random.default_rng(6)
    for window in (10, 16, 1024):
        lengths = np.sort(rng.integers(1, window + 1, 300))[::-1]
        where, offset = packing.best_fit(lengths, window)
        room: dict[int, int] = {}
        for n, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
            fits = [r for r in room.values() if r >= n]
            tightest = min(fits) if fits else window
            assert room.get(w, window) == tightest and o == window - tightest
            room[w] = tightest - n


# Null ids, long addresses, tables that go


def test_sharding_of_rows_without_id(spark):
    texts = ["same text"] * 60 + [None, ""] + ["t%d" % k for k in range(100)]
    rows = [(None if k % 3 == 0 else k, t) for k, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=5, together=True).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for k in range(5):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    hot = sorted({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same text")})
    assert hot == list(range(hot[0], hot[-1] + 1))  # more than a shard's share, so it lies in shards side by side


def test_long_spelled_addresses_are_taken_whole():
    finder = personal.Finder()
    for text, want in ((f"{'x' * 90} [at] host [dot] org", (0, 110)), ("a (at)b(dot)com", (0, 15)), ("[at] host [dot] org", None), ("é x.y-z[ at ]h[ dot ]co, a(at)b", (2, 23))):
        assert finder.spelled(text) == ([want] if want else [])
    text = f"write to {'x' * 90} [at] {'h' * 70} [dot] {'t' * 30} now"
    spans = [s for s, _ in finder.candidates(text, finder.base(text))]
    assert spans == [("address", 9, 9 + 90 + 6 + 70 + 7 + 30)]


def test_stages_delete_what_they_wrote(spark):
    from tidelens.functions import storage

    frame = docs(spark, near_texts() + [LONG, None, "", "one two"])
    storage.clear(spark)
    kept = ngram_join.keep_one(frame)
    assert len(storage.WRITTEN) == 1  # the copies that go
    assert kept.count() < frame.count()
    storage.clear(spark)
    with storage.scratch(spark) as keep:
        a = storage.cut_lineage(spark.range(3).toDF("id"))
        b = keep(storage.cut_lineage(spark.range(4).toDF("id")))
    assert storage.WRITTEN == {b.written_to} and a.written_to != b.written_to and b.count() == 4
    storage.clear(spark)
    assert not storage.WRITTEN


def test_unknown_suffixes_are_judged_by_lexical_features(spark):
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    good = [f"http://{word(5)}.{tld}/{word(4)}" for tld in ("com", "net") for _ in range(60)]
    bad = [f"http://{word(9)}-{rng.integers(10**6)}.{tld}/{'en' if tld == 'com' else 'es'}/{word(20)}?a={rng.integers(10**9)}" for tld in ("com", "net") for _ in range(60)]
    rest = [f"http://{word(5)}.org/{word(4)}" for _ in range(30)] + [f"http://{word(9)}-{rng.integers(10**6)}.org/en/{word(20)}?a={rng.integers(10**9)}" for _ in range(30)]
    pages = spark.createDataFrame(list(enumerate(good + bad + rest)), "page_id long, url string")
    rules = {"com/": "allow", "com/en/": "block", "net/": "allow", "net/es/": "block"}
    got = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    last = [got[k] for k in range(240, 300)]
    assert all(r.rule is None for r in last) and len({r.score for r in last}) > 1
    assert np.mean([r.verdict == ("allow" if k < 30 else "block") for k, r in enumerate(last)]) >= 0.9


def test_null_ids_stay(spark):
    """Rows without id are answered like others."""
    texts = ["write to me@example.org today", "write to me@example.org today", None, "alpha beta gamma delta epsilon zeta"]
    frame = spark.createDataFrame([(None if k < 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    weights = personal.fit(frame)
    assert Counter((r.doc_id, len(r.base)) for r in personal.find(frame, weights).collect()) == Counter({(None, 1): 2, (None, 0): 1, (3, 0): 1})
    model = language.ByteCnn(["en", "fr"], widths=(2,), filters=2, window=8)
    assert Counter((r.doc_id, r.lang_pred == "und") for r in language.predict(frame, model).collect()) == Counter({(None, False): 2, (None, True): 1, (3, False): 1})
    pieces = packing.pack_documents(frame, packing.tokenizer_path()).collect()
    assert Counter(r.doc_id for r in pieces) == Counter({None: 3, 3: 1})
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    assert {(r.doc_id, r.text) for r in decontaminate.clean(frame, items).collect()} == {(None, None), (3, texts[3])}
    labels = spark.createDataFrame([(None, 1), (3, 0)], "doc_id long, toxic int")
    scores = toxicity.score(frame, toxicity.fit(frame, labels)).collect()
    assert Counter(r.doc_id for r in scores) == Counter({None: 3, 3: 1})
    pages = spark.createDataFrame([(None, "http://a.com/x"), (None, "http://a.com/x"), (4, None)], "page_id long, url string")
    assert Counter((r.page_id, r.rule) for r in urls.judge(pages).collect()) == Counter({(None, "com/"): 2, (4, None): 1})
