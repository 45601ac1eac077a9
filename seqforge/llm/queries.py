"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from seqforge.llm import (classifier, ctw, decontaminate, hard_negatives, html_text, jaccard_join, mixing, quality, simhash,
                          substring_dedup, suffix_dedup, token_alignment, warc)
from seqforge.llm.common import table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"))


def op4_ctw(spark, sf_dir):
    return ctw.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.digest(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark, sf_dir):
    return html_text.digest(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    return classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark, sf_dir):
    return token_alignment.digest(table(spark, sf_dir, "documents"))


def op13_jaccard_join(spark, sf_dir):
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_simhash, op3_quality_rules, op4_ctw, op5_mixing, op6_warc, op7_decontaminate,
    op8_html_text, op9_suffix_dedup,
    op10_quality_classifier, op11_hard_negatives, op12_token_alignment, op13_jaccard_join)}

SQL = {
    "op1_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM t, unnest(range(1, len(w) - 48)) AS u(p)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN least USING (s) WHERE doc_id > first),
lost AS (SELECT doc_id, list(q) AS q FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(q), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(q, []), i)), ' ')) AS kept_sha256
FROM t LEFT JOIN lost USING (doc_id)""",
    "op6_warc": """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM m""",
    "op7_decontaminate": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS u(p)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM t, sizes, unnest(range(1, len(w) - n + 2)) AS u(p)),
found AS (SELECT doc_id, p, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 3""",
}
