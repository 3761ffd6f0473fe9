"""Hard negatives, importance resampling and secret scans against plain versions, with their defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import negatives, resampling, secrets
from tidelens.llm.common import table

# Hard negatives


def plain_negatives(rows, is_anchor, k=5, low=80):
    """rows: distinct (id, label, whole-number vector)."""
    want = Counter()
    x = np.array([v for _, _, v in rows], float)
    for a, (i, label, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        score = (x @ np.array(v, float)).astype(np.int64)
        order = sorted(range(len(rows)), key=lambda r: (-score[r], rows[r][0]))
        for p in [r for r in order if rows[r][1] == label and rows[r][0] != i][:k]:
            top = score[p]
            fit = [r for r in order if rows[r][1] != label and low * top <= 100 * score[r] <= 100 * top]
            for rank, n in enumerate(fit[:k], 1):
                want[(i, rows[p][0], rank, rows[n][0], int(top), int(score[n]))] += 1
    return want


EMBEDDINGS = "vec_id long, embedding array<double>, label int, no int, leaf int"


@pytest.mark.parametrize(("sample_rows", "leaf_rows", "block_rows"), [(4000, 20, 50), (60, 100, 4096), (5, 2000, 33)])
def test_negatives(spark, sample_rows, leaf_rows, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 6))
    x = centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 6)) * 0.2
    x[300:600] = x[300]  # a vector that a third of the rows share
    x[600:640] = 0
    label = rng.integers(0, 4, 900)
    rows = [(k, [float(v) for v in r], int(c), 0, 0) for k, (r, c) in enumerate(zip(x, label, strict=True))]
    rows += [(5, rows[5][1], rows[5][2], 0, 0), (None, rows[0][1], 1, 0, 0), (1000, None, 1, 0, 0), (1010, rows[0][1], None, 0, 0), (1020, [math.nan] + [1.0] * 5, 1, 0, 0)]
    rows += [(1030, [None] + [1.0] * 5, 1, 0, 0), (1040, [1.0], 1, 0, 0), (1050, [], 1, 0, 0), (1060, [math.inf] + [1.0] * 5, 1, 0, 0), (10, [1.5] * 6, 2, 0, 0)]
    df = spark.createDataFrame(rows, EMBEDDINGS)
    got = Counter(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), sample_rows=sample_rows, leaf_rows=leaf_rows, block_rows=block_rows).collect())
    sound = {(i, c, tuple(math.floor(256 * v) for v in e)) for i, e, c, _, _ in rows if i is not None and e and c is not None and len(e) == 6 and all(v is not None and math.isfinite(v) for v in e)}
    assert got == plain_negatives(sorted(sound), lambda i: i % 10 == 0)


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0], 1, 0, 0), (1, [1.0, 0.0], 2, 0, 0)], EMBEDDINGS)
    every = F.col("vec_id") % 100 == 0
    assert negatives.mine(df, every, F.col("label")).count() == 0  # no positive
    assert negatives.mine(df.limit(0), every, F.col("label")).count() == 0
    assert negatives.mine(df.filter("vec_id = 1"), every, F.col("label")).count() == 0


def test_tree_leaves_siblings_out():
    """Windows on clustered vectors visit few leaves; no row within a window lies elsewhere."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((50, 16)) * 200
    x = np.floor(centres[rng.integers(0, 50, 5000)] + rng.standard_normal((5000, 16)) * 8)
    tree = negatives.Gnat(x[:1000], 10)
    tree.widen(x)
    leaf, q = tree.leaf(x), x[:100]
    score = q @ x.T
    most = np.sort(score, axis=1)[:, -2:-1]
    least = np.ceil(0.98 * most)
    asked, leaves = tree.visited(q, least, most)
    seen = set(zip(asked.tolist(), leaves.tolist(), strict=True))
    for a, b in zip(*np.nonzero((score >= least) & (score <= most)), strict=True):
        assert (a, leaf[b]) in seen
    assert len(seen) < 0.25 * tree.leaves * len(q)


# Importance resampling


def plain_resampling(docs, target, longest, buckets, percent, least_words, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[a : a + k]).encode()) % buckets for k in range(1, longest + 1) for a in range(len(words) - k + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, words, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f) // max(1, len(f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    draw = percent * len(able) // 100
    ranks = {id(r): k for k, r in enumerate(able[:draw], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


TEXTS = ["", None, "one", "Two words", "É é 中文 ² ½ a-b_c'd", "x" * 300, "a\x00b {c} `d`", "word " * 3000, "ÀÉ"]


@pytest.mark.parametrize(("longest", "head", "piece"), [(1, 1 << 15, 1 << 20), (3, 50, 64), (2, 4, 1 << 20)])
def test_resampling(spark, monkeypatch, longest, head, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = np.random.default_rng(6)
    words = ["w%d" % k for k in range(300)] + ["Über", "naïve", "CAPS"]
    texts = TEXTS + [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(200)] + ["same text of some words " * 6] * 100
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, "same text of some words " * 6), (None, "short")]
    target = [" ".join(rng.choice(words[:40], 30)) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, rank int").repartition(3)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    for percent, least in ((10, 20), (100, 0), (0, 5)):
        got = resampling.resample(frame, aim, longest=longest, buckets=97, percent=percent, least_words=least, head=head, rows_per_range=20)
        assert Counter(tuple(r) for r in got.collect()) == plain_resampling(docs, target, longest, 97, percent, least, 2024)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(docs, docs.limit(0).select("text"), least_words=0, percent=50).collect()) == plain_resampling([(1, "a b"), (2, None)], [], 1, 10_000, 50, 0, 2024)


def test_heavy_words_stay():
    heavy = resampling.Heavy(100)
    for k in range(500):
        heavy.update([b"often"] * 5 + [b"w%d" % (20 * k + j) for j in range(20)])
    assert heavy.counts.most_common(1)[0][0] == b"often" and len(heavy.counts) <= 100


def test_long_texts_go_by_pieces():
    text = "ab cd " * 400_000 + "x" * 3_000_000 + " end"
    parts = list(resampling.pieces(text))
    assert len(parts) > 2 and [w for p in parts for w in p] == text.encode().split()


# Secret scans


def plain_base(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]


def plain_added(text, base):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/=_-]+", text):
        word, s = m[0], m.start()
        if any(a < m.end() and b > s for _, a, b in base) or secrets.Scanner().suppressed(word):
            continue
        of = next((c for c in secrets.CLASSES if re.fullmatch(c.pattern, word)), None)
        if of is None:
            continue
        spans = []
        for k in range(len(word) - of.window + 1):
            part = word[k : k + of.window]
            entropy = -sum(n / of.window * math.log2(n / of.window) for n in Counter(part).values())
            if entropy >= of.share * math.log2(min(of.window, of.size)) - 1e-9 and re.search("[0-9]", part) and re.search("[A-Za-z]", part):
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + of.window
                else:
                    spans.append([k, k + of.window])
        out += [(of.kind, s + a, s + b) for a, b in spans]
    return out


def secret_texts():
    rng = np.random.default_rng(2)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [None, "", "nothing here", "password: hunter2hunter2", "PassWord = 'abcdefgh'", "token=secret:abcdefgh", "api_key=short", "apikey:\"abcdefgh.ijk\"", "ſecret=abcdefgh", "toKen=abcdefgh"]
    texts += ["AKIA" + draw("ABCDEFGHIJ234567", n) for n in (5, 11, 12, 16)] + [draw("0123456789abcdef", n) for n in (31, 32, 64)] + ["é中 " + draw("0123456789ABCDEF", 40) + " x"]
    texts += [f"see {draw(alnum, n)}, end" for n in (19, 20, 24, 60)] + [f"k {draw(alnum + '+/', 44)}= k" for _ in range(5)] + [f"{draw(alnum + '_-', 40)}" for _ in range(5)]
    texts += ["a" * 100 + draw(alnum, 40) + "b" * 100 + draw(alnum, 30), "123e4567-e89b-12d3-a456-426614174000", "docs/some-long-path-of-words-2024/IndexPage", "HTTPServerFactoryBeanConfiguration", "EXAMPLE" + draw(alnum, 30)]
    texts += [draw(alnum + " =:'\"/+_-.", int(rng.integers(1, 120))) for _ in range(200)] + [draw(alnum, 30_000), "z" * 200_000, "token " * 3000, "aB" * 50_000 + "!"]
    return texts


def test_secrets(spark, tmp_path):
    rows = [(k, t, 1) for k, t in enumerate(secret_texts())] + [(4, secret_texts()[4], 1), (None, "token=abcdefgh", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    order = secrets.BASE_KINDS + secrets.ADDED_KINDS
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))
    want = Counter()
    for i, t, _ in rows:
        base = plain_base(t or "")
        added = plain_added(t or "", base)
        n = [sum(k == kind for k, _, _ in base) for kind in secrets.BASE_KINDS]
        want[(i, *n, hashlib.sha256(said(base).encode()).hexdigest(), said(base + added), len(added))] += 1
    assert Counter(tuple(r) for r in secrets.op13_secrets(spark, str(tmp_path)).collect()) == want
    assert sum(n * k[-1] for k, n in want.items()) > 20
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_allow_list_and_redaction(spark):
    word = "q7Rw2LzX9vKe4TnB8mYs1HdP"
    docs = spark.createDataFrame([(1, f"x {word} y password=hunter2hunter2", 5), (2, None, 5), (3, "clean", 5)], "doc_id long, text string, entropy int")
    assert [r.text for r in secrets.redact(docs).collect()] == ["x <entropy_alnum> y <assign>", None, "clean"]
    assert [r.text for r in secrets.redact(docs, allowed={word}).collect()][0] == f"x {word} y <assign>"
    found = {r.doc_id: r for r in secrets.find(docs).collect()}
    assert found[1].added[0].entropy > 4.3 and not found[3].added


def test_incremental_entropy_is_exact():
    of = secrets.CLASSES[1]
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdefgh0123456789ABCDEFGHIJ"), 5000))
    term = secrets.terms(of.window)
    hits = secrets.Sliding(of).hits(word)
    sums = [sum(term[n] for n in Counter(word[k : k + of.window]).values()) for k in range(len(word) - of.window + 1)]
    covered = {k for a, b, _ in hits for k in range(a, b)}
    assert covered == {j for k, v in enumerate(sums) if v <= secrets.Sliding(of).most and re.search("[0-9]", word[k : k + of.window]) and re.search("[A-Za-z]", word[k : k + of.window]) for j in range(k, k + of.window)}


def test_secrets_of_the_given_texts(spark, tables):
    got = secrets.op13_secrets(spark, tables)
    texts = {r.doc_id: r.text or "" for r in table(spark, tables, "documents").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.n_assign + r.n_access + r.n_hex == len(base) and r.n_added == len(plain_added(texts[r.doc_id], base))
