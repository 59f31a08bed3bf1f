"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import (collocations, filter_audit, fingerprint, html_extract, language_id, license_scan, metric_join, ngram_join, packing,
                          quality, secret_scan, sentencepiece_table, topk_search)
from basketry.llm.common import read
from basketry.session import materialize


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return topk_search.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP2_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepiece_table.encode_digests(docs, tokenizer_file("piece_bpe_32k.model"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(read(spark, sf_dir, "documents", "doc_id", "text"))


def packed_documents(docs: DataFrame) -> DataFrame:
    cut = materialize(packing.pieces(docs, tokenizer_file("byte_bpe_50k.json"), added_tokens=True), "pieces")
    return packing.pack(cut, shards=packing.shard_count(cut.count()))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * common >= 75 * (p.n + q.n - common)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION
    SELECT reach.node, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.seen)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""


def language_model(docs: DataFrame) -> dict:
    return language_id.fit(docs.where(language_id.remainder("doc_id", 5) != 0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language_id.predict(docs, language_model(docs))
    held_out = F.coalesce(language_id.remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    return quality.fit(docs, labels.where(language_id.remainder("doc_id", 3) != 1))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = quality.score(docs, quality_model(docs, read(spark, sf_dir, "labels", "doc_id", "quality")))
    held_out = F.coalesce(language_id.remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP11_SQL = """
WITH RECURSIVE usable AS (
    SELECT row_number() OVER () AS node, vec_id, label, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.node AS x, b.node AS y
    FROM usable a JOIN usable b ON a.label = b.label AND a.node <> b.node AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach AS (
    SELECT node, node AS seen FROM usable
    UNION
    SELECT reach.node, links.y FROM reach JOIN links ON links.x = reach.seen),
least AS (SELECT r.node, min(u.vec_id) AS component_id FROM reach r JOIN usable u ON u.node = r.seen GROUP BY r.node),
told AS (
    SELECT u.vec_id, coalesce(d.n, 0) AS n_links, l.component_id
    FROM usable u JOIN least l ON l.node = u.node LEFT JOIN degree d ON d.x = u.node
    UNION ALL
    SELECT vec_id, 0, vec_id FROM embeddings
    WHERE vec_id IS NULL OR label IS NULL OR embedding IS NULL
       OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0
       OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM told
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_audit.masks(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return filter_audit.audit(filter_audit.weigh(found, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marked AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
           len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
           100 * length(regexp_replace(split.t, '[^A-Z]', '', 'g')) > 10 * length(split.t) AS c,
           regexp_matches(split.t, '[#$%&*|]') AS d, coalesce(split.doc_id > first, false) AS e
    FROM split JOIN firsts ON firsts.t = split.t LEFT JOIN marked ON marked.doc_id = split.doc_id),
masks AS (
    SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(bad) AS bad,
           concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                  CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails
    FROM failing GROUP BY part, a, b, c, d, e),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order
    FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x)
    JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
    SELECT part, filter_order, step, f,
           sum(n) - sum(CASE WHEN regexp_matches(fails, concat('[', substr(filter_order, 1, step), ']')) THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN contains(fails, f) AND NOT (step > 1 AND regexp_matches(fails, concat('[', substr(filter_order, 1, greatest(step - 1, 1)), ']'))) THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN contains(fails, f) AND step > 1 AND regexp_matches(fails, concat('[', substr(filter_order, 1, greatest(step - 1, 1)), ']')) THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN contains(fails, f) AND NOT (step > 1 AND regexp_matches(fails, concat('[', substr(filter_order, 1, greatest(step - 1, 1)), ']'))) THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN contains(fails, f) AND NOT (step > 1 AND regexp_matches(fails, concat('[', substr(filter_order, 1, greatest(step - 1, 1)), ']'))) THEN bad ELSE 0 END) AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents", "text", "lang"))


OP13_SQL = r"""
WITH lowered AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM lowered),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM words, (SELECT unnest(range(1, 6)) AS m) sizes),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
inner_phrases AS (
    SELECT lang, a, array_to_string(w[s:s + m2 - 1], ' ') AS phrase
    FROM candidates, (SELECT unnest(range(2, 5)) AS m2) x, (SELECT unnest(range(1, 5)) AS s) y
    WHERE m2 < m AND s + m2 - 1 <= m),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, phrase),
alone AS (
    SELECT c.* FROM candidates c LEFT JOIN around o ON o.lang = c.lang AND o.phrase = c.phrase
    WHERE o.most IS NULL OR 100 * o.most < 100 * c.a),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest
    FROM alone, (SELECT unnest(range(1, 5)) AS k) ks WHERE k < m),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n,
           (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
    JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS turn FROM scored),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest WHERE turn = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


LLM_QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_topk_search": op2_topk_search,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_fingerprint": op4_fingerprint,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_license_scan": op7_license_scan,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}
LLM_ORACLE = {
    "op2_topk_search": OP2_SQL,
    "op8_ngram_jaccard": OP8_SQL,
    "op11_embedding_near_dedup": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
