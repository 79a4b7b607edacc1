"""Score and aggregate queries over documents with labels, orders, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..sources.tables import HOUR, OBS_SQL, ORDERS_SQL, observations, order_intervals, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def labelled(spark, d):
    """doc_id, source, lang, truth (quality class), called (a class from the length) and score."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    la = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(la, "doc_id").withColumn("truth", F.concat(F.lit("q"), F.col("quality") + F.col("toxic"))).withColumn("called", F.when(F.col("n_chars") < 600, "q0").when(F.col("n_chars") < 4000, "q1").otherwise("q2"))


_LAB = "lb AS (SELECT d.doc_id, source, lang, n_chars, quality, toxic, 'q' || (quality + toxic) AS truth, CASE WHEN n_chars < 600 THEN 'q0' WHEN n_chars < 4000 THEN 'q1' ELSE 'q2' END AS called FROM documents d JOIN labels USING (doc_id))"


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def a1_counts(spark, d):
    return sc.counts_with_total(table(spark, d, "events"), "event_type")


@query(f"""WITH {OBS_SQL}, l AS (SELECT person_id // 3 AS pair, person_id, arg_max(CASE WHEN zone = 'view' THEN NULL WHEN zone = 'error' THEN 'HIGH_RISK' ELSE 'CLEAR' END, ms) AS dummy,
 list(CASE WHEN zone = 'view' THEN NULL WHEN zone = 'error' THEN 'HIGH_RISK' ELSE 'CLEAR' END ORDER BY ms DESC, event_id DESC)[1] AS v, max(person_id % 3 // 2) AS e FROM ev GROUP BY 1, 2),
c AS (SELECT pair, coalesce(bool_or(v = 'HIGH_RISK'), false) AS flagged, bool_or(v = 'HIGH_RISK') AS raw, max(e) AS expected, count(*) AS people, count(v) AS decided FROM l GROUP BY pair)
SELECT pair, raw AS flagged, expected, people, decided, CASE WHEN decided = 0 THEN 'no_verdict' WHEN expected = 1 AND flagged THEN 'hit' WHEN expected = 1 THEN 'miss' WHEN flagged THEN 'false_alarm' ELSE 'pass' END AS outcome FROM c""")
def a2_verdict_score(spark, d):
    o = observations(spark, d).withColumn("pair", F.expr("person_id div 3")).withColumn("verdict", F.when(F.col("zone") == "error", "HIGH_RISK").when(F.col("zone") != "view", "CLEAR")).withColumn("expected", F.expr("person_id % 3 div 2")).withColumn("at", F.struct("ms", "event_id"))
    last = o.groupBy("pair", "person_id").agg(F.max(F.struct("at", "verdict")).alias("m"), F.max("expected").alias("expected")).select("pair", "person_id", "m.at", "m.verdict", "expected")
    return sc.verdict_score(last, "pair", "person_id", "at", "verdict", "expected")


@query(f"""WITH {_LAB} SELECT source, lang, count(*) AS n, count(*) FILTER (truth = called) AS correct, array_to_string(list(doc_id ORDER BY doc_id) FILTER (truth <> called AND doc_id % 10 = 0), ',') AS wrong FROM lb GROUP BY ROLLUP (source, lang)""")
def a3_summary_by_set(spark, d):
    lb = labelled(spark, d)
    wrong = F.when((F.col("truth") != F.col("called")) & (F.col("doc_id") % 10 == 0), F.col("doc_id"))
    r = lb.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("called")).alias("correct"), F.array_sort(F.collect_list(wrong)).alias("wrong"))
    return r.withColumn("wrong", F.when(F.size("wrong") > 0, F.array_join("wrong", ",")))


@query(f"WITH {_LAB} SELECT truth, count(*) FILTER (called = 'q0') AS q0, count(*) FILTER (called = 'q1') AS q1, count(*) FILTER (called = 'q2') AS q2 FROM lb GROUP BY truth")
def a4_confusion(spark, d):
    c = sc.confusion(labelled(spark, d), "truth", "called")
    return c.groupBy("truth").pivot("called", ["q0", "q1", "q2"]).agg(F.sum("n")).na.fill(0)


@query(f"""WITH {_LAB}, k AS (SELECT unnest(['q0', 'q1', 'q2']) AS cls),
m AS (SELECT cls, (SELECT count(*) FROM lb WHERE truth = cls) AS support, (SELECT count(*) FROM lb WHERE truth = cls AND called = cls) AS tp, (SELECT count(*) FROM lb WHERE called = cls) AS called FROM k),
p AS (SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM m WHERE support + called > 0), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM p)
SELECT cls, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(avg(f) OVER (), 6) AS macro_f1, round(sum(tp) OVER () / sum(support) OVER (), 6) AS accuracy FROM f""")
def a5_class_report(spark, d):
    r = sc.class_report(labelled(spark, d), "truth", "called")
    return r.select("cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1", "accuracy")])


@query(f"""WITH {_LAB}, p AS (SELECT source, n_chars AS s FROM lb WHERE quality = 1), q AS (SELECT source, n_chars AS s FROM lb WHERE quality = 0)
SELECT k.source, round((SELECT sum(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0 END) / count(*) FROM p JOIN q ON p.source = q.source WHERE p.source = k.source), 6) AS auc, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM lb k GROUP BY k.source""")
def a6_auc(spark, d):
    a = sc.auc(labelled(spark, d), ["source"], F.col("quality") == 1, "n_chars")
    return a.withColumn("auc", F.round("auc", 6))


@query(f"""WITH {OBS_SQL} SELECT zone AS store, round(count(*) FILTER (value >= 40) / count(*), 6) AS rate, round(count(*) FILTER (value < 10) / 24.0, 6) AS false_per_hour, count(*) FILTER (value < 2) AS duplicates,
 round(quantile_cont(value, 0.5) FILTER (value >= 40), 6) AS p50, round(avg(value) FILTER (value >= 40), 6) AS mean, round(quantile_cont(value, 0.9) FILTER (value >= 40), 6) AS p90, max(value) FILTER (value >= 40) AS worst FROM ev GROUP BY zone""")
def a7_alert_metrics(spark, d):
    """Alert metrics by store."""
    v = F.col("value")
    return sc.alert_metrics(observations(spark, d).withColumnRenamed("zone", "store"), ["store"], v >= 40, v < 10, v < 2, v, F.lit(24.0))


@query("""SELECT lang, source, count(*) AS files, sum(n_chars) AS frames, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (n_chars < 100) AS short FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY CUBE (lang, source)""")
def a9_dataset_profile(spark, d):
    la = table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    j = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(la, "doc_id", "left")
    return j.cube("lang", "source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("frames"), F.count("has").alias("labelled"), F.count_if(F.col("n_chars") < 100).alias("short"))


@query("""WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, min(n_chars) AS low, max(n_chars) FILTER (i = n // 4) AS p25, max(n_chars) FILTER (i = n // 2) AS p50, max(n_chars) FILTER (i = n * 3 // 4) AS p75, max(n_chars) AS high, round(avg(n_chars), 6) AS mean FROM s GROUP BY lang""")
def a10_index_quantiles(spark, d):
    return sc.index_quantiles(table(spark, d, "documents"), ["lang"], "n_chars")


@query("SELECT l_orderkey AS cart, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS total, CAST(sum(l_quantity) AS BIGINT) AS items FROM lineitem GROUP BY l_orderkey")
def a11_cart_totals(spark, d):
    q, p = F.col("l_quantity").cast("bigint"), F.round("l_extendedprice").cast("bigint")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cart")).agg(F.sum(q * p).alias("total"), F.sum("l_quantity").cast("bigint").alias("items"))


@query(f"""WITH {OBS_SQL}, s AS (SELECT *, ms - lag(ms) OVER (PARTITION BY person_id ORDER BY ms, event_id) AS st FROM ev)
SELECT person_id, min(ms) AS first, max(ms) AS last, count(*) AS length, min(st) AS min_step, max(st) AS max_step, count(*) <= 3 AS flicker FROM s GROUP BY person_id""")
def a12_track_summary(spark, d):
    return sc.track_summary(observations(spark, d), ["person_id"], "ms", "event_id")


@query(f"""WITH {OBS_SQL}, n AS (SELECT person_id, count(*) AS t FROM ev GROUP BY 1) SELECT person_id, count(*) FILTER (zone = 'view') AS view, count(*) FILTER (zone = 'click') AS click, count(*) FILTER (zone = 'error') AS error, round(count(*) FILTER (zone = 'view') / any_value(t), 6) AS view_share FROM ev JOIN n USING (person_id) GROUP BY person_id""")
def a13_zone_dwell(spark, d):
    p = observations(spark, d).groupBy("person_id").agg(*[F.count_if(F.col("zone") == z).alias(z) for z in ("view", "click", "error")], F.count(F.lit(1)).alias("t"))
    return p.withColumn("view_share", F.round(F.col("view") / F.col("t"), 6)).drop("t")


@query(f"""WITH t AS (SELECT count(*) AS n FROM events), {OBS_SQL}, p AS (SELECT a.label = b.label AS same, list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) AS s FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id),
h AS (SELECT quantile_cont(s, 0.95) FILTER (NOT same) AS th FROM p) SELECT round(max(th), 6) AS threshold, round(avg(CASE WHEN s > th THEN 1.0 ELSE 0 END) FILTER (same), 6) AS recall FROM p, h""")
def a18_threshold_at_rate(spark, d):
    from ..functions.geometry import dot

    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    p = e.join(b, "vec_id").withColumn("s", dot(F.col("embedding"), F.col("e2")))
    return sc.threshold_at_rate(p, F.col("label") != F.col("l2"), "s", 0.05)


@query("""SELECT l_linenumber AS lane, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r,
 round((SELECT quantile_cont(abs(x.l_extendedprice - f.a * x.l_quantity - f.b), 0.5) FROM lineitem x WHERE x.l_linenumber = k.l_linenumber), 3) AS median_error
FROM lineitem k JOIN (SELECT l_linenumber AS n, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1) f ON f.n = k.l_linenumber GROUP BY l_linenumber, f.a, f.b""")
def a21_calibration(spark, d):
    c = sc.calibration(table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "lane"), ["lane"], "l_quantity", "l_extendedprice")
    return c.select("lane", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"), F.round("median_error", 3).alias("median_error"))


@query(f"""WITH {OBS_SQL}, c AS (SELECT zone, person_id, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT zone, person_id AS modal, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, person_id) AS k FROM c) WHERE k = 1""")
def a23_modal_person(spark, d):
    return sc.modal(observations(spark, d), ["zone"], "person_id")


@query(f"""WITH {ORDERS_SQL}, p AS (SELECT key % 50 AS k, s, e FROM iv WHERE id % 2 = 0), l0 AS (SELECT key % 50 AS k, s, e FROM iv WHERE id % 2 = 1),
l1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM l0), l2 AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM l1),
l AS (SELECT k, min(s) AS s, max(e) AS e FROM l2 GROUP BY k, g), c AS (SELECT p.k, sum(greatest(least(p.e, l.e) - greatest(p.s, l.s), 0)) AS covered FROM p JOIN l ON p.k = l.k AND p.s <= l.e AND p.e >= l.s GROUP BY p.k)
SELECT q.k, q.present, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(100.0 * coalesce(covered, 0) / present, 6) AS percent FROM (SELECT k, CAST(sum(e - s) AS BIGINT) AS present FROM p GROUP BY k) q LEFT JOIN c ON c.k = q.k""")
def a24_coverage(spark, d):
    iv = order_intervals(spark, d).withColumn("k", F.col("key") % 50)
    return sc.coverage(iv.where("id % 2 = 0").select("k", "s", "e"), iv.where("id % 2 = 1").select("k", "s", "e"), ["k"], 8)


@query(f"""WITH {_LAB} SELECT truth, count(*) AS n, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q75, round(quantile_cont(n_chars, 0.5) / (SELECT quantile_cont(n_chars, 0.5) FROM lb), 6) AS ratio FROM lb GROUP BY truth""")
def a26_separability(spark, d):
    lb = labelled(spark, d)
    p = lambda q: F.percentile("n_chars", F.lit(q))
    whole = lb.agg(p(0.5).alias("all"))
    g = lb.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), p(0.25).alias("q25"), p(0.5).alias("median"), p(0.75).alias("q75"))
    return g.join(F.broadcast(whole), how="cross").withColumn("ratio", F.round(F.col("median") / F.col("all"), 6)).drop("all")  # one row


@query(f"""WITH {OBS_SQL}, w AS (SELECT person_id % 5 AS lane, ms // {24 * HOUR} * {24 * HOUR} AS w, value FROM ev), b AS (SELECT lane, quantile_cont(value, 0.5) AS base FROM w WHERE w < (SELECT min(w) FROM w) + {72 * HOUR} GROUP BY lane)
SELECT lane, w AS window_ms, quantile_cont(value, 0.5) AS median, min(value) AS low, max(value) AS high, count(*) FILTER (value < 5) AS invalid, round(quantile_cont(value, 0.5) - any_value(base), 6) AS deviation FROM w JOIN b USING (lane) GROUP BY lane, w""")
def a28_sensor_health(spark, d):
    """Daily windows of each lane against the median of its first three days."""
    day = F.floor(F.col("ms") / (24 * HOUR)) * (24 * HOUR)
    o = observations(spark, d).select((F.col("person_id") % 5).alias("lane"), day.alias("window_ms"), "value")
    start = o.agg(F.min("window_ms").alias("t0"))
    med = F.percentile("value", F.lit(0.5))
    base = o.join(F.broadcast(start), how="cross").where(F.col("window_ms") < F.col("t0") + 72 * HOUR).groupBy("lane").agg(med.alias("base"))  # one row
    w = o.groupBy("lane", "window_ms").agg(med.alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") < 5).alias("invalid"))
    return w.join(base, "lane").withColumn("deviation", F.round(F.col("median") - F.col("base"), 6)).drop("base")


_TH = [x / 20 for x in range(1, 20)]


@query(f"""WITH {_LAB}, s AS (SELECT quality = 1 AS t, n_chars / (n_chars + 1500.0) AS s FROM lb), h AS (SELECT unnest({_TH}) AS th),
c AS (SELECT th, avg(CASE WHEN s >= th THEN 1.0 ELSE 0 END) FILTER (NOT t) AS fa, avg(CASE WHEN s >= th THEN 1.0 ELSE 0 END) FILTER (t) AS de FROM s, h GROUP BY th)
SELECT th AS threshold, round(fa, 6) AS false_alarm, round(de, 6) AS detection, row_number() OVER (ORDER BY round(de - fa, 9) DESC, th) = 1 AS best FROM c""")
def a33_operating_curve(spark, d):
    c = sc.operating_curve(labelled(spark, d), F.col("quality") == 1, F.col("n_chars") / (F.col("n_chars") + 1500.0), _TH)
    return c.select("threshold", F.round("false_alarm", 6).alias("false_alarm"), F.round("detection", 6).alias("detection"), "best")


@query(f"""WITH {_LAB} SELECT truth, count(*) FILTER (truth = called) AS found, count(*) AS total, count(*) FILTER (called = 'q0' AND truth <> 'q0') AS as_q0, count(*) FILTER (called = 'q2' AND truth <> 'q2') AS as_q2 FROM lb GROUP BY truth""")
def a35_class_hits(spark, d):
    t, c = F.col("truth"), F.col("called")
    return labelled(spark, d).groupBy("truth").agg(F.count_if(t == c).alias("found"), F.count(F.lit(1)).alias("total"), F.count_if((c == "q0") & (t != c)).alias("as_q0"), F.count_if((c == "q2") & (t != c)).alias("as_q2"))


@query(f"""WITH {OBS_SQL} SELECT zone, count(*) AS rows, count(DISTINCT person_id) AS people, count(DISTINCT person_id % 100) AS tracks, count(*) FILTER (value < 1) AS unassigned FROM ev GROUP BY zone""")
def a36_run_statistics(spark, d):
    return observations(spark, d).groupBy("zone").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("person_id").alias("people"), F.countDistinct(F.col("person_id") % 100).alias("tracks"), F.count_if(F.col("value") < 1).alias("unassigned"))


@query(f"""WITH {OBS_SQL} SELECT person_id % 10 AS recording, least(floor(value / 25) * 25, 100.0) AS band, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90 FROM ev GROUP BY 1, 2""")
def a38_distance_bands(spark, d):
    o = observations(spark, d).withColumn("recording", F.col("person_id") % 10).withColumn("band", F.least(F.floor(F.col("value") / 25) * 25.0, F.lit(100.0)))
    return o.groupBy("recording", "band").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.9)).alias("p90"))


@query("""WITH c AS (SELECT lang AS cls, count(*) AS n FROM documents GROUP BY 1) SELECT cls, n, CASE WHEN cls = 'en' THEN 1.0 ELSE round(greatest(0.2, least(5.0, (SELECT avg(n) FROM c WHERE cls <> 'en') / n)), 6) END AS weight FROM c""")
def x19_class_weights(spark, d):
    return sc.class_weights(table(spark, d, "documents").withColumnRenamed("lang", "cls"), "cls", "en")


@query(f"""WITH {OBS_SQL}, m AS (SELECT person_id % 10 AS video, value AS dt FROM ev), g AS (SELECT quantile_cont(dt, 0.5) AS base FROM m), v AS (SELECT video, count(*) AS n, quantile_cont(dt, 0.5) AS med, max(dt) - min(dt) AS spread FROM m GROUP BY video)
SELECT video, n, round(med - base, 6) AS shift, CASE WHEN n < 2 THEN 'few' WHEN spread > 900 THEN 'spread' WHEN abs(med - base) > 2 THEN 'far' ELSE 'ok' END AS reason FROM v, g""")
def a30_offset_fit(spark, d):
    """Per-video offset against the global median, with the reason for refusing it."""
    m = observations(spark, d).select((F.col("person_id") % 10).alias("video"), F.col("value").alias("dt"))
    med = F.percentile("dt", F.lit(0.5))
    v = m.groupBy("video").agg(F.count(F.lit(1)).alias("n"), med.alias("med"), (F.max("dt") - F.min("dt")).alias("spread"))
    shift = F.col("med") - F.col("base")
    j = v.join(F.broadcast(m.agg(med.alias("base"))), how="cross")  # one row
    return j.select("video", "n", F.round(shift, 6).alias("shift"), F.when(F.col("n") < 2, "few").when(F.col("spread") > 900, "spread").when(F.abs(shift) > 2, "far").otherwise("ok").alias("reason"))


@query(f"""WITH {_LAB}, g AS (SELECT unnest([100, 300, 1000, 3000]) AS lo, unnest([4000, 6000, 9000, 20000]) AS hi),
r AS (SELECT lo, hi, doc_id % 3 = 0 AS test, count(*) FILTER (n_chars BETWEEN lo AND hi AND quality = 1) AS tp, count(*) FILTER (n_chars BETWEEN lo AND hi) AS called, count(*) FILTER (quality = 1) AS support FROM lb, g GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN called + support > 0 THEN 2.0 * tp / (called + support) ELSE 0 END AS f1 FROM r), b AS (SELECT lo, hi FROM f WHERE NOT test ORDER BY f1 DESC, lo, hi LIMIT 1)
SELECT f.lo, f.hi, round(f1, 6) AS test_f1, (SELECT lo FROM b) = f.lo AND (SELECT hi FROM b) = f.hi AS chosen FROM f WHERE test""")
def a31_parameter_sweep(spark, d):
    """F1 of each parameter row on the test part, with the one chosen on the training part. The grid is four rows."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((100, 4000), (300, 6000), (1000, 9000), (3000, 20000))]))
    r = labelled(spark, d).select((F.col("doc_id") % 3 == 0).alias("test"), "n_chars", "quality", grid.alias("g")).select("test", "n_chars", "quality", "g.*")
    fired, good = F.col("n_chars").between(F.col("lo"), F.col("hi")), F.col("quality") == 1
    f = r.groupBy("lo", "hi", "test").agg(F.count_if(fired & good).alias("tp"), F.count_if(fired).alias("called"), F.count_if(good).alias("support")).withColumn("f1", sc.ratio(2.0 * F.col("tp"), F.col("called") + F.col("support")))
    best = f.where("not test").agg(F.max_by(F.struct("lo", "hi"), F.struct("f1", -F.col("lo"), -F.col("hi"))).alias("b"))
    return f.where("test").join(F.broadcast(best), how="cross").select("lo", "hi", F.round("f1", 6).alias("test_f1"), (F.col("b") == F.struct("lo", "hi")).alias("chosen"))  # one row
