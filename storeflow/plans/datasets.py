"""Text, validation, dataset and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import datasets as ds
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query("""WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000007 AS VARCHAR), 12, '0') AS c FROM part)
SELECT p_partkey, c || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(c, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR) AS ean FROM p""")
def x1_ean13(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919 % 1000000007).cast("string"), 12, "0").alias("c"))
    return p.select("p_partkey", F.concat("c", tx.ean13_check_digit(F.col("c")).cast("string")).alias("ean"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' 49-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ' 1 ' WHEN p_partkey % 3 = 1 THEN ' ' || p_name || ' ' ELSE CAST(p_partkey % 1000 AS VARCHAR) END AS c FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(replace(replace(trim(c), ' ', ''), '-', ''), '^[0-9]{6,}$') THEN replace(replace(trim(c), ' ', ''), '-', '') ELSE trim(c) END AS code FROM p""")
def x2_barcodes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    c = F.when(k % 3 == 0, F.concat(F.lit(" 49-"), F.lpad(s, 6, "0"), F.lit(" 1 "))).when(k % 3 == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise((k % 1000).cast("string"))
    return table(spark, d, "part").select("p_partkey", tx.normalize_barcode(c).alias("code"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR NOT regexp_matches('P' || p_partkey, '^[A-Za-z0-9._-]{3,64}$') THEN 'barcode' WHEN p_size % 10 = 0 THEN 'name' WHEN p_retailprice <> floor(p_retailprice) THEN 'price' END AS error FROM part""")
def p2_product_errors(spark, d):
    k = F.col("p_partkey")
    code = F.when(k % 5 != 0, F.concat(F.lit("P"), k.cast("string")))
    return table(spark, d, "part").select("p_partkey", tx.product_error(code, F.when(F.col("p_size") % 10 == 0, F.lit("  ")).otherwise(F.col("p_name")), F.col("p_retailprice")).alias("error"))


@query("""WITH e AS (SELECT event_id, event_id % 7 - 3 + value / 1000 AS dt, round_even(value * 37 * 1000, 0) AS ms FROM events)
SELECT event_id, CASE WHEN abs(dt) <= 1.5 THEN 'on_time' WHEN abs(dt) <= 2.5 THEN 'borderline' WHEN dt > 0 THEN 'late' ELSE 'early' END AS delay,
 printf('%02d:%02d:%02d.%03d', CAST(ms AS BIGINT) // 3600000, CAST(ms AS BIGINT) // 60000 % 60, CAST(ms AS BIGINT) // 1000 % 60, CAST(ms AS BIGINT) % 1000) AS clock FROM e""")
def x14_delays(spark, d):
    """Delay classes and clock texts."""
    return table(spark, d, "events").select("event_id", tx.delay_class(F.col("event_id") % 7 - 3 + F.col("value") / 1000).alias("delay"), tx.clock_text(F.col("value") * 37).alias("clock"))


@query("""SELECT page_id, regexp_replace('rtsp://u' || page_id || ':pw@' || regexp_replace(url, '^[a-z]+://', ''), '(://)[^/@:]+:[^/@]+@', '\\1***:***@') AS masked, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages""")
def x13_masked_urls(spark, d):
    u = F.concat(F.lit("rtsp://u"), F.col("page_id").cast("string"), F.lit(":pw@"), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, d, "pages").select("page_id", tx.mask_credentials(u).alias("masked"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'clip_' || source WHEN doc_id % 9 = 1 THEN upper(source) || '_DF' || doc_id ELSE lang || '_' || upper(source) || '_DF' || doc_id || '_cam' || (doc_id % 4) || '_x' END AS stem FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN 'DF' || doc_id END AS df, CASE WHEN doc_id % 9 > 0 THEN lower(string_split(stem, '_')[CASE WHEN doc_id % 9 = 1 THEN 1 ELSE 2 END]) END AS store, CASE WHEN doc_id % 9 > 1 THEN CAST(doc_id % 4 AS VARCHAR) END AS camera, CASE WHEN doc_id % 9 = 0 THEN 'no DF number' WHEN doc_id % 9 = 1 THEN 'no camera' END AS error FROM s""")
def x3_recording_names(spark, d):
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    stem = F.when(k % 9 == 0, F.concat(F.lit("clip_"), "source")).when(k % 9 == 1, F.concat(F.upper("source"), F.lit("_DF"), s)).otherwise(F.concat("lang", F.lit("_"), F.upper("source"), F.lit("_DF"), s, F.lit("_cam"), (k % 4).cast("string"), F.lit("_x")))
    return table(spark, d, "documents").select("doc_id", tx.stem_parts(stem).alias("p")).select("doc_id", "p.*")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts + INTERVAL 9 HOUR, '%H:%M:%S') AS local, printf('%s: %d -> %d (%+d)', event_type, event_id % 5, event_id % 3, event_id % 3 - event_id % 5) AS line FROM events""")
def x18_event_lines(spark, d):
    """JSON properties, local clock times, one-line descriptions."""
    e = table(spark, d, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), tx.local_clock(iso, "Asia/Seoul").alias("local"), tx.event_text(F.col("event_type"), F.col("event_id") % 5, F.col("event_id") % 3).alias("line"))


_TAKES = "t AS (SELECT doc_id, source || '-' || doc_id // 200 AS take, lang, source FROM documents), c AS (SELECT take, lang, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT take, arg_min(lang, (-n, lang)) AS cls FROM c GROUP BY take)"


def takes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("-"), F.expr("doc_id div 200").cast("string")).alias("take"), "lang", "source")


@query(f"""WITH {_TAKES}, r AS (SELECT *, count(*) OVER (PARTITION BY cls) AS n, row_number() OVER (PARTITION BY cls ORDER BY md5('1337|' || take)) AS k FROM m)
SELECT take, cls, CASE WHEN k <= greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) THEN 'val' ELSE 'train' END AS split FROM r""")
def d1_group_split(spark, d):
    return ds.group_split(takes(spark, d), "take", "lang", 0.15)


@query(f"""WITH {_TAKES}, r AS (SELECT *, count(*) OVER (PARTITION BY cls) AS n, row_number() OVER (PARTITION BY cls ORDER BY md5('1337|' || take)) AS k FROM m),
s AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) ELSE 0 END AS nt FROM r), v AS (SELECT *, CASE WHEN n - nt >= 2 THEN greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) ELSE 0 END AS nv FROM s)
SELECT take, cls, CASE WHEN k <= nt THEN 'test' WHEN k <= nt + nv THEN 'val' ELSE 'train' END AS split FROM v""")
def d3_three_way_split(spark, d):
    return ds.group_split(takes(spark, d), "take", "lang", 0.15, 0.2)


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT source, arg_min(lang, (-n, lang)) AS cls FROM c GROUP BY source), r AS (SELECT *, count(*) OVER (PARTITION BY cls) AS n, row_number() OVER (PARTITION BY cls ORDER BY md5('7|' || source)) AS k FROM m)
SELECT source, CASE WHEN k <= greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) THEN 'val' ELSE 'train' END AS split FROM r""")
def d2_store_split(spark, d):
    return ds.group_split(table(spark, d, "documents"), "source", "lang", 0.15, seed=7).select("source", "split")


_SPL = "t AS (SELECT doc_id, source || '-' || doc_id // 200 AS take, source, CASE doc_id % 11 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents)"


def deployed(spark, d):
    m = F.col("doc_id") % 11
    return takes(spark, d).withColumn("split", F.when(m == 0, "val").when(m == 1, "test").otherwise("train"))


@query(f"WITH {_SPL} SELECT doc_id, take, split FROM t WHERE split <> 'train' OR take NOT IN (SELECT take FROM t WHERE split <> 'train')")
def d4_drop_leaks(spark, d):
    return ds.drop_leaks(deployed(spark, d).select("doc_id", "take", "split"), "take", "split")


@query(f"WITH {_SPL} SELECT take, array_to_string(list_sort(list(DISTINCT split)), ',') AS sides FROM t GROUP BY take HAVING count(DISTINCT split) > 1")
def d5_leak_report(spark, d):
    """Takes found on more than one side."""
    return ds.leaks(deployed(spark, d), "take", "split").withColumn("sides", F.array_join("sides", ","))


@query("""WITH t AS (SELECT lang, source, source || '-' || doc_id // 200 AS take, count(*) AS clips FROM documents GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('1337|' || take)) AS turn FROM t),
b AS (SELECT *, coalesce(sum(clips) OVER (PARTITION BY lang ORDER BY turn, source, take ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT lang, source, take, clips, CAST(before AS BIGINT) AS before FROM b WHERE before < 60""")
def d6_quota(spark, d):
    return ds.quota(takes(spark, d), "lang", "source", "take", 60)


@query("SELECT p_partkey, p_brand, CASE (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 5 WHEN 2 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS split FROM part")
def d7_ordinal_split(spark, d):
    return ds.ordinal_split(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("""WITH m AS (SELECT doc_id, md5(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 13 <> 0), f AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN md5('x') ELSE md5(coalesce(text, '')) END AS sha FROM documents WHERE doc_id % 19 <> 0)
SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, CASE WHEN f.sha IS NULL THEN 'missing' WHEN m.sha IS NULL THEN 'extra' WHEN m.sha <> f.sha THEN 'changed' ELSE 'ok' END AS status FROM m FULL JOIN f ON m.doc_id = f.doc_id""")
def d8_integrity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("sha"))
    have = docs.where("doc_id % 19 <> 0").withColumn("sha", F.when(F.col("doc_id") % 17 == 0, F.md5(F.lit("x"))).otherwise(F.col("sha")))
    return ds.integrity(docs.where("doc_id % 13 <> 0"), have, "doc_id", "sha")


@query("""WITH c AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, (SELECT count(DISTINCT lang) FROM documents) AS k, CAST('0x' || substr(md5('1337|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents) SELECT doc_id, lang FROM c WHERE u * n * k < 200""")
def d10_weighted_sample(spark, d):
    return ds.weighted_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 200)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k <= 3")
def d11_first_sessions(spark, d):
    """The first three of each subject."""
    return ds.limited(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).drop("o_orderdate")


@query("SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def k1_newest_first(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "value")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY event_id), '>') AS history FROM events GROUP BY user_id")
def k2_case_history(spark, d):
    h = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("h"))
    return h.select("user_id", F.array_join(F.transform("h", lambda s: s["event_type"]), ">").alias("history"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def k3_top_by_rank(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("""WITH kept AS (SELECT * FROM documents WHERE source IS NULL OR source NOT LIKE '%3'), nw AS (SELECT doc_id, source, 'new' AS origin FROM kept WHERE lang = 'en')
SELECT doc_id, source, 'old' AS origin FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM nw) UNION ALL SELECT * FROM nw""")
def u4_merge_with_exclusions(spark, d):
    """All documents, of which those in English come anew and replace the old ones; excluded sources go."""
    docs = table(spark, d, "documents").where("source is null or source not like '%3'")
    old, new = docs.select("doc_id", "source", F.lit("old").alias("origin")), docs.where("lang = 'en'").select("doc_id", "source", F.lit("new").alias("origin"))
    return ds.replace_keys(old, new, ["doc_id"])


@query("""WITH old AS (SELECT o_custkey AS k, o_orderkey AS id, 'old' AS src, o_orderstatus = 'P' AS edited FROM orders), dr AS (SELECT o_custkey AS k, o_orderkey AS id, 'draft' AS src, false AS edited FROM orders WHERE o_orderpriority = '1-URGENT'),
ok AS (SELECT * FROM dr WHERE k NOT IN (SELECT k FROM old WHERE edited)) SELECT k, id, src FROM old WHERE k NOT IN (SELECT k FROM ok) UNION ALL SELECT k, id, src FROM ok""")
def u5_protected_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("edited"), "o_orderpriority")
    old = o.drop("o_orderpriority").withColumn("src", F.lit("old"))
    draft = o.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority").withColumn("src", F.lit("draft")).withColumn("edited", F.lit(False))
    return ds.protected_merge(old, draft, "k", F.col("edited")).select("k", "id", "src")


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'))) AS missing_keys, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS rows, false AS allowed""")
def u7_write_guard(spark, d):
    o = table(spark, d, "orders")
    return ds.write_guard(o, o.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("""SELECT d.doc_id, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'no_label' END, CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN toxic = 1 AND quality = 1 THEN 'class_mismatch' END) AS problems, (l.doc_id IS NOT NULL AND n_chars >= 100) AS usable FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def p13_problem_flags(spark, d):
    """Problems of each row, and whether it may be used."""
    la = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("has"))
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(la, "doc_id", "left")
    has, short = F.coalesce("has", F.lit(False)), F.col("n_chars") < 100
    p = ds.problems(no_label=~has, short=short, class_mismatch=(F.col("toxic") == 1) & (F.col("quality") == 1))
    return j.select("doc_id", F.array_join(p, ",").alias("problems"), (has & ~short).alias("usable"))


@query("""SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'late' WHEN value < 2 THEN 'invalid' WHEN value > 400 THEN 'out_of_range' ELSE 'ok' END AS status FROM events""")
def p3_admissibility(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 23 == 0, "late").when(v < 2, "invalid").when(v > 400, "out_of_range").otherwise("ok").alias("status"))


@query("""WITH a AS (SELECT doc_id, lower(regexp_replace(trim(' ' || upper(lang) || '_'), '[ _]', '', 'g')) AS k FROM documents), m(k, id) AS (VALUES ('en', 1), ('fr', 2), ('de', 3)) SELECT a.doc_id, m.id AS class_id FROM a LEFT JOIN m USING (k)""")
def p8_alias_mapping(spark, d):
    aliases = spark.createDataFrame([("en", 1), ("fr", 2), ("de", 3)], "k string, class_id int")
    k = F.lower(F.regexp_replace(F.concat(F.lit(" "), F.upper("lang"), F.lit("_")), "[ _]", ""))
    return table(spark, d, "documents").select("doc_id", k.alias("k")).join(F.broadcast(aliases), "k", "left").select("doc_id", "class_id")  # three rows


@query("SELECT user_id % 50 AS pair, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'missing' WHEN bool_or(event_type = 'purchase' AND value < 3) THEN 'draft' ELSE 'verified' END AS state FROM events GROUP BY 1")
def p18_label_state(spark, d):
    buy = F.col("event_type") == "purchase"
    g = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("pair")).agg(F.count_if(buy).alias("n"), F.bool_or(buy & (F.col("value") < 3)).alias("draft"))
    return g.select("pair", F.when(F.col("n") == 0, "missing").when(F.col("draft"), "draft").otherwise("verified").alias("state"))
