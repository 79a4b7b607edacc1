"""op10: every document against every benchmark item."""

from __future__ import annotations

from .decontaminate import contamination


def op10_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, bench)


QUERIES = {"op10_decontaminate": op10_decontaminate}

ORACLES = {
    "op10_decontaminate": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
cand AS (
  SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS win
  FROM pos, (SELECT DISTINCT m FROM win) WHERE i + m - 1 <= len(ws)),
occ AS (SELECT doc_id, i, m, item FROM cand JOIN win USING (m, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
