"""op5: every page archived, normalised and read back."""

from __future__ import annotations

from .warc import archive_and_read


def op5_warc(spark, sf_dir):
    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_warc": op5_warc}

ORACLES = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS n, list_transform(range(1, 41, 5), lambda k: CAST('0x' || substr(sha1(html), k, 5) AS BIGINT)) AS g FROM p),
e AS (
  SELECT page_id, n, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((g[CAST(i // 4 AS BIGINT) + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS digest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY digest) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY digest) THEN NULL ELSE min(page_id) OVER (PARTITION BY digest) END AS refers_to
FROM e
"""
}
