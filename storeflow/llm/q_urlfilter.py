"""op2: every page's url against the prefix rules and the glob patterns."""

from __future__ import annotations

from .urlfilter import GLOBS, judge_urls


def op2_urlfilter(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _like(glob: str) -> str:
    return glob.replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%").replace("?", "_")


_BLOCKED = " OR ".join(f"host || path LIKE '{_like(g)}' ESCAPE '!'" for g in GLOBS)

QUERIES = {"op2_urlfilter": op2_urlfilter}

ORACLES = {
    "op2_urlfilter": f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (
  SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, verdict DESC, rh || rp) AS k
  FROM u, r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON u.page_id = f.page_id AND f.k = 1
"""
}
