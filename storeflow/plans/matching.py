"""Matching queries. Decisions that depend on earlier ones have no plain SQL form; tests hold them to small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import cosine
from ..operators import matching as mt
from ..operators import scoring as sc
from ..sources.tables import HOUR, OBS_SQL, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _sides(spark, d, a: str, b: str, names: tuple[str, str]):
    o = observations(spark, d).where(F.col("zone").isin(a, b))
    return o.select("person_id", F.when(F.col("zone") == a, names[0]).otherwise(names[1]).alias("side"), F.col("event_id").alias("id"), F.col("ms").alias("start_ms"), (F.col("ms") + 2 * HOUR).alias("end_ms"), (F.col("ms") / 1000.0).alias("at"), F.when(F.col("event_id") % 3 == 0, "BROWSE").otherwise("TAKE").alias("kind"))


@query()
def m1_match_alerts(spark, d):
    return mt.match_alerts(_sides(spark, d, "error", "click", ("alert", "event")).drop("at", "kind"), ["person_id"], 3 * HOUR)


@query()
def m2_match_candidates(spark, d):
    return mt.match_candidates(_sides(spark, d, "view", "click", ("candidate", "label")).drop("at"), ["person_id"])


@query()
def m3_match_labels(spark, d):
    return mt.match_labels(_sides(spark, d, "view", "click", ("label", "sensor")).drop("start_ms", "end_ms", "kind"), ["person_id"], 2 * 3600.0, 8 * 3600.0)


@query()
def m4_staged_compare(spark, d):
    """Labels and sensor events unit by unit, within a lane and then across lanes."""
    o = observations(spark, d).select((F.col("person_id") % 40).alias("pair"), (F.col("person_id") % 3).alias("lane"), F.when(F.col("event_id") % 2 == 0, "TAKE").otherwise("RETURN").alias("direction"), F.col("event_id").alias("id"), (F.col("ms") / 1000.0).alias("at"), (1 + F.col("event_id") % 3).cast("int").alias("qty"), "zone")
    side = lambda z: o.where(F.col("zone") == z).drop("zone")
    return mt.staged_compare(side("click"), side("view"), "pair", "lane", "direction", 2 * 3600.0, 8 * 3600.0)


@query()
def m5_cross_view_assignment(spark, d):
    """Vectors of even against odd ids in windows of forty, by appearance and position, best total score."""
    e = table(spark, d, "embeddings").withColumn("win", F.expr("vec_id div 40"))
    a = e.where("vec_id % 2 = 0").select("win", F.col("vec_id").alias("detail_id"), F.col("embedding").alias("ea"))
    b = e.where("vec_id % 2 = 1").select("win", F.col("vec_id").alias("overview_id"), F.col("embedding").alias("eb"))
    near = 1 - F.abs(F.col("detail_id") - F.col("overview_id")) / 40.0
    s = a.join(b, "win").select("win", "detail_id", "overview_id", (0.7 * near + 0.3 * cosine(F.col("ea"), F.col("eb"))).alias("score"))
    return mt.assign(s, ["win"], "detail_id", "overview_id", "score", 0.5)


@query()
def m7_identity_remap(spark, d):
    """Ids of two runs over a recording of fifty persons mapped one to one by shared frames."""
    o = observations(spark, d).withColumn("slot", F.floor(F.col("ms") / (6 * HOUR))).withColumn("run", F.expr("person_id div 50"))
    side = lambda odd, n, c: o.where(F.col("event_id") % 2 == odd).groupBy("run", "slot", F.col("person_id").alias(n)).agg(F.count(F.lit(1)).alias(c))  # noqa: E731  one row a person and slot
    s = side(0, "old_id", "a").join(side(1, "new_id", "b"), ["run", "slot"]).groupBy("run", "old_id", "new_id").agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("score"))
    return mt.greedy_map(s, ["run"], "old_id", "new_id", "score", 1.0)


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS cand, list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) AS s, sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) ** 2)) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) ** 2))) AS n FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND b.vec_id < a.vec_id),
c AS (SELECT id, cand, least(greatest(s / n, 0), 1) + CASE WHEN id - cand <= 3 THEN 0.05 ELSE 0 END AS v FROM p)
SELECT id, cand AS matched, round(v, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(v, 9) DESC, cand) AS k FROM c) WHERE k = 1 AND v >= 0.1""")
def m9_appearance_match(spark, d):
    """Best earlier template in the same window of twenty; near ones get a bonus; a threshold decides."""
    e = table(spark, d, "embeddings").withColumn("w", F.expr("vec_id div 20"))
    b = e.select("w", F.col("vec_id").alias("cand"), F.col("embedding").alias("eb"))
    p = e.join(b, "w").where("cand < vec_id").withColumn("v", cosine(F.col("embedding"), F.col("eb")) + F.when(F.col("vec_id") - F.col("cand") <= 3, 0.05).otherwise(0.0))
    best = p.groupBy(F.col("vec_id").alias("id")).agg(F.max(F.struct(F.round("v", 9).alias("r"), (-F.col("cand")).alias("c"), "v")).alias("b"))
    return best.where("b.v >= 0.1").select("id", (-F.col("b.c")).alias("matched"), F.round("b.v", 5).alias("similarity"))


@query(f"""WITH {OBS_SQL}, x AS (SELECT person_id % 12 AS setting, value, CASE WHEN value < 20 THEN 'right' WHEN value < 60 THEN 'wrong' ELSE 'none' END AS k FROM ev)
SELECT setting, count(*) FILTER (k = 'right') AS "right", count(*) FILTER (k = 'wrong') AS wrong, count(*) FILTER (k = 'none') AS "none", round(count(*) FILTER (k = 'right') / greatest(count(*) FILTER (k <> 'none'), 1), 6) AS precision FROM x GROUP BY setting""")
def m11_ownership_score(spark, d):
    v = F.col("value")
    g = observations(spark, d).groupBy((F.col("person_id") % 12).alias("setting")).agg(F.count_if(v < 20).alias("right"), F.count_if((v >= 20) & (v < 60)).alias("wrong"), F.count_if(v >= 60).alias("none"))
    return g.withColumn("precision", F.round(F.col("right") / F.greatest(F.col("right") + F.col("wrong"), F.lit(1)), 6))


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY person_id ORDER BY ms, event_id) <= {20 * HOUR} THEN 0 ELSE 1 END AS new FROM ev WHERE zone = 'purchase'), r AS (SELECT *, sum(new) OVER (PARTITION BY person_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT person_id, max(ms) AS time_ms, count(*) AS items, CASE WHEN person_id % 10 = 0 THEN 'none' ELSE 'paid' END AS result FROM r GROUP BY person_id, g""")
def m13_draft_payment_labels(spark, d):
    """One row a scan group: paid at its last scan, with the number of scans."""
    from ..operators.windows import point_groups

    g = point_groups(observations(spark, d).where("zone = 'purchase'"), ["person_id"], "ms", "event_id", 20 * HOUR)
    return g.select("person_id", F.col("end_ms").alias("time_ms"), "items", F.when(F.col("person_id") % 10 == 0, "none").otherwise("paid").alias("result"))


@query()
def k4_reading_order(spark, d):
    """Objects of each frame in rows and places; the running row mean is recursive."""
    li = table(spark, d, "lineitem")
    b = li.select(F.col("l_orderkey").alias("shelf"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 400).alias("y"), F.lit(12.0).alias("h"))
    return mt.reading_order(b, ["shelf"], "id", "x", "y", "h")


@query()
def a15_consensus(spark, d):
    """Objects that stay near one place over a customer's orders."""
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    f = j.select(F.col("o_custkey").alias("shelf"), F.col("o_orderkey").alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 400).alias("y"), F.col("l_returnflag").alias("label"), F.col("l_tax").alias("score"))
    return mt.consensus(f, ["shelf"], ("x", "y"), "label", "score", "frame", 0.4, 8.0)


@query(f"""WITH {OBS_SQL}, x AS (SELECT person_id, ms, event_id, value, lead(value, 1) OVER o AS n1, lead(value, 2) OVER o AS n2, lag(value, 1) OVER o AS p1, lag(value, 2) OVER o AS p2 FROM ev WINDOW o AS (PARTITION BY person_id ORDER BY ms, event_id))
SELECT event_id, round(abs((p1 + p2) / 2 - (n1 + n2) / 2), 6) AS contrast, abs((p1 + p2) / 2 - (n1 + n2) / 2) > 40 AS swapped FROM x WHERE p2 IS NOT NULL AND n2 IS NOT NULL AND value > 80""")
def w28_before_after(spark, d):
    """Means just before and just after an occlusion, compared."""
    from pyspark.sql import Window

    w = Window.partitionBy("person_id").orderBy("ms", "event_id")
    x = observations(spark, d).withColumn("before", F.avg("value").over(w.rowsBetween(-2, -1))).withColumn("after", F.avg("value").over(w.rowsBetween(1, 2))).withColumn("p2", F.lag("value", 2).over(w)).withColumn("n2", F.lead("value", 2).over(w))
    c = F.abs(F.col("before") - F.col("after"))
    return x.where("p2 is not null and n2 is not null and value > 80").select("event_id", F.round(c, 6).alias("contrast"), (c > 40).alias("swapped"))


@query(f"""WITH {OBS_SQL}, m AS (SELECT person_id, corr(value, ms // {HOUR} % 24) AS r, count(*) AS n, quantile_cont(value, 0.5) AS med FROM ev GROUP BY 1)
SELECT person_id, CASE WHEN abs(r) >= 0.2 AND n >= 60 THEN 'correlation' ELSE 'median' END AS method, round(CASE WHEN abs(r) >= 0.2 AND n >= 60 THEN r ELSE med END, 5) AS value, array_to_string([x FOR x IN [CASE WHEN n < 60 THEN 'few samples' END, CASE WHEN abs(r) < 0.2 THEN 'weak' END] IF x IS NOT NULL], ';') AS reasons FROM m""")
def w27_two_evidence(spark, d):
    """Correlation where it is strong and well supported, otherwise the median, with reasons."""
    o = observations(spark, d).withColumn("hour", F.floor(F.col("ms") / HOUR) % 24)
    m = o.groupBy("person_id").agg(F.corr("value", "hour").alias("r"), F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("med"))
    good = (F.abs("r") >= 0.2) & (F.col("n") >= 60)
    reasons = F.array_compact(F.array(F.when(F.col("n") < 60, "few samples"), F.when(F.abs("r") < 0.2, "weak")))
    return m.select("person_id", F.when(good, "correlation").otherwise("median").alias("method"), F.round(F.when(good, F.col("r")).otherwise(F.col("med")), 5).alias("value"), F.array_join(reasons, ";").alias("reasons"))


@query(f"""WITH {OBS_SQL}, b AS (SELECT *, value < 30 AS blocked FROM ev), e AS (SELECT *, CASE WHEN blocked IS NOT DISTINCT FROM lag(blocked) OVER o THEN 0 ELSE 1 END AS edge FROM b WINDOW o AS (PARTITION BY person_id ORDER BY ms, event_id)),
g AS (SELECT *, sum(edge) OVER (PARTITION BY person_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), r AS (SELECT person_id, run, bool_and(blocked) AS blocked, min(ms) AS s, max(ms) AS t, arg_min(value, (ms, event_id)) AS first_v, arg_max(value, (ms, event_id)) AS last_v FROM g GROUP BY 1, 2),
n AS (SELECT *, lag(last_v) OVER o AS before, lead(first_v) OVER o AS after, lead(t - s) OVER o AS clear FROM r WINDOW o AS (PARTITION BY person_id ORDER BY run))
SELECT person_id, s AS start_ms, t AS end_ms, CASE WHEN after IS NULL THEN 'unfinished' WHEN before IS NULL THEN 'no_reference' WHEN after > before + 20 THEN 'INCREASED' WHEN after < before - 20 THEN 'DECREASED' ELSE 'CHANGED' END AS direction FROM n WHERE blocked""")
def st11_slot_changes(spark, d):
    """Blocked stretches of a slot with what it showed before and after."""
    from pyspark.sql import Window

    from ..operators.windows import islands

    w = Window.partitionBy("person_id").orderBy("ms", "event_id")
    o = observations(spark, d).withColumn("blocked", F.col("value") < 30)
    r = islands(o, ["person_id"], ["ms", "event_id"], ~F.col("blocked").eqNullSafe(F.lag("blocked").over(w)), "run")
    at = F.struct("ms", "event_id")
    r = r.groupBy("person_id", "run").agg(F.bool_and("blocked").alias("blocked"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.min_by("value", at).alias("first_v"), F.max_by("value", at).alias("last_v"))
    k = Window.partitionBy("person_id").orderBy("run")
    n = r.withColumn("before", F.lag("last_v").over(k)).withColumn("after", F.lead("first_v").over(k)).where("blocked")
    before, after = F.col("before"), F.col("after")  # a difference of doubles rounds elsewhere than the sum
    kind = F.when(after.isNull(), "unfinished").when(before.isNull(), "no_reference").when(after > before + 20, "INCREASED").when(after < before - 20, "DECREASED").otherwise("CHANGED")
    return n.select("person_id", "start_ms", "end_ms", kind.alias("direction"))


@query("""WITH m AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings), n AS (SELECT label, k <= 3 AS recent, i, sum(CAST(embedding[i] AS DOUBLE)) AS v FROM m, range(1, 65) t(i) GROUP BY 1, 2, 3),
p AS (SELECT a.label, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS c FROM n a JOIN n b ON a.label = b.label AND a.i = b.i AND a.recent AND NOT b.recent GROUP BY a.label)
SELECT label, CASE WHEN (SELECT count(*) FROM m WHERE m.label = p.label) >= 9 THEN round(least(greatest(c, 0), 1), 5) END AS consistency FROM p""")
def a19_consistency(spark, d):
    """The last three samples of each identity against all older ones; null when there are too few."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    m = e.withColumn("recent", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id"))) <= 3)
    s = m.select("label", "recent", F.posexplode("embedding").alias("i", "v")).groupBy("label", "recent", "i").agg(F.sum(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    vec = s.groupBy("label").agg(*[F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("i", "v")))), lambda x: x["v"]).alias(n) for c, n in ((F.col("recent"), "a"), (~F.col("recent"), "b"))], F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"))
    return vec.where(F.size("a") > 0).where(F.size("b") > 0).select("label", F.when(F.col("n") >= 9, F.round(cosine(F.col("a"), F.col("b")), 5)).alias("consistency"))
