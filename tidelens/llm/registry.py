"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, negatives, neighbours, ngram_join, packing, personal, resampling, secrets, sharding, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_personal": personal.op5_personal,
    "op6_urls": urls.op6_urls,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language": language.op8_language,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
    "op11_negatives": negatives.op11_negatives,
    "op12_resampling": resampling.op12_resampling,
    "op13_secrets": secrets.op13_secrets,
}

A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: Words of op12 in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base 32 of the hexadecimal digest h: five hexadecimal digits make four letters.
BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {shift}) % 32 + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
        SELECT page_id, payload_bytes, {BASE32} AS payload_digest,
            CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < newest THEN newest END AS refers_to
        FROM q""",
    "op4_ngram_join": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
        FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)""",
    "op9_sharding": """
        WITH crc_table AS (SELECT list(v ORDER BY k) AS crc_of FROM (SELECT k, list_reduce([k] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(k))),
        bytes AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
        ordered AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id) - size AS a, row_number() OVER (ORDER BY h, doc_id) - 1 AS place, sum(size) OVER () AS total FROM bytes),
        grouped AS (SELECT *, min(a) OVER (PARTITION BY h) AS first, max(a + size) OVER (PARTITION BY h) AS last FROM ordered),
        placed AS (SELECT *, least(23, CASE WHEN (last - first) * 24 <= total THEN (first + last) * 24 // (2 * total) ELSE (2 * a + size) * 24 // (2 * total) END)::INTEGER AS shard FROM grouped)
        SELECT doc_id, size, xor(4294967295, list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, crc_of[xor(c, x) % 256 + 1]))) AS text_crc32,
            'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
        FROM placed, crc_table""",
    "op11_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op12_resampling": f"""
        WITH crc_table AS (SELECT list(v ORDER BY k) AS crc_of FROM (SELECT k, list_reduce([k] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(k))),
        docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '{WORD}') AS w FROM documents),
        items AS (SELECT unnest(regexp_extract_all(translate(text, {A_TO_Z}), '{WORD}')) AS word FROM benchmark),
        words AS (SELECT r, unnest(w) AS word FROM docs),
        vocabulary AS (SELECT word, list_transform(regexp_extract_all(hex(word), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM (SELECT word FROM words UNION SELECT word FROM items)),
        buckets AS (SELECT word, xor(4294967295, list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, crc_of[xor(c, x) % 256 + 1]))) % 10000 AS bucket FROM vocabulary, crc_table),
        s AS (SELECT bucket, count(*) AS s FROM words JOIN buckets USING (word) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS t FROM items JOIN buckets USING (word) GROUP BY 1),
        gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM words) + 10000) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM items) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
        means AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS mean FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY 1),
        scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(mean, 0) AS weight,
            coalesce(mean, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM docs LEFT JOIN means USING (r)),
        places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM places) // 100 THEN rank END AS rank FROM scored LEFT JOIN places USING (r)""",
}
