"""Shelf, dataset and small-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shelf as sh
from ..operators import shelfwatch as sw
from ..sources.tables import HOUR, OBS_SQL, observations, pieces, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def m6_slot_matching(spark, d):
    """Lines of an order before and after, matched slot by slot; greedy: no SQL form."""
    li = table(spark, d, "lineitem")
    s = li.select(F.col("l_orderkey").alias("visit"), F.when(F.col("l_linenumber") % 2 == 0, "before").otherwise("after").alias("side"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.lit(8.0).alias("size"), F.col("l_returnflag").alias("label"))
    return sh.slot_changes(s, ["visit"])


@query()
def st10_shelf_monitor(spark, d):
    """Item counts of each user's shelf around times when it is hidden; recursive: no SQL form."""
    o = observations(spark, d).select("person_id", "ms", "event_id", (F.col("zone") == "error").alias("occluded"), (F.floor(F.col("value") / 60)).cast("int").alias("items"))
    return sh.shelf_visits(o, ["person_id"], "ms", "event_id", 6 * HOUR)


@query()
def st10_item_monitor(spark, d):
    """Visits to each user's shelf of six items, which are there or not for five days at a time; recursive: no SQL form."""
    o = observations(spark, d)
    stretch = F.floor(F.col("ms") / (120 * HOUR))
    x, jitter = F.col("k") * 60.0, F.pmod(F.col("event_id") * 7 + F.col("k"), F.lit(5)).cast("double")
    item = F.struct(F.when(F.col("event_id") % 9 == 0, "jar").otherwise("tin").alias("label"), (x + jitter).alias("x1"), jitter.alias("y1"), (x + jitter + 40).alias("x2"), (jitter + 40).alias("y2"), (F.pmod(F.col("event_id") * 13 + F.col("k") * 5, F.lit(10)) / 10).alias("score"))
    there = F.pmod(F.col("person_id") + stretch * (F.col("k") + 1), F.lit(3)) != 0
    f = o.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).groupBy("person_id", "ms", "event_id", "zone").agg(F.sort_array(F.collect_list(F.when(there, item))).alias("items"))
    f = f.withColumn("blockers", F.when(F.col("zone") == "error", F.array(F.col("event_id") % 5)))
    return sw.watch_shelves(f, ["person_id"], "ms", "event_id", stable=12 * HOUR, window=4, presence=0.5, floor=0.2)


@query("""WITH b AS (SELECT o_custkey AS shelf, o_orderkey AS frame, l_orderkey * 8 + l_linenumber AS slot, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_quantity AS DOUBLE) + 20 AS x2, CAST(l_discount AS DOUBLE) * 100 AS y1, CAST(l_discount AS DOUBLE) * 100 + 20 AS y2, CAST(l_tax AS DOUBLE) AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
n AS (SELECT shelf, count(DISTINCT frame) AS frames FROM b GROUP BY 1),
h AS (SELECT a.shelf, a.slot, count(DISTINCT b.frame) AS hits FROM b a JOIN b ON a.shelf = b.shelf AND greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / (800 - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) >= 0.5 AND b.score >= 0.5 * a.score GROUP BY 1, 2)
SELECT b.shelf, b.slot, n.frames, coalesce(h.hits, 0) AS hits, coalesce(h.hits, 0) >= 0.3 * n.frames AS present FROM b JOIN n USING (shelf) LEFT JOIN h ON h.shelf = b.shelf AND h.slot = b.slot""")
def a16_weak_presence(spark, d):
    """Whether a line's box shows, at least faintly, in three of ten of its customer's orders."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    x, y = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100
    n = pieces(li)
    b = li.repartition(n, "l_orderkey").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("shelf"), F.col("o_orderkey").alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("slot"), x.alias("x1"), (x + 20).alias("x2"), y.alias("y1"), (y + 20).alias("y2"), F.col("l_tax").cast("double").alias("score"))
    b = b.repartition(n, "shelf")
    return sw.weak_presence(b, b, ["shelf"], "slot", "frame")


@query(f"""WITH {OBS_SQL}, m AS (SELECT person_id, event_id, ms FROM ev WHERE zone = 'click'), x AS (SELECT person_id, kind, prio, ms + sh AS at FROM m, (VALUES ('take', 0, 0), ('scan', {3 * HOUR}, 1), ('carry', {9 * HOUR}, 2)) v(kind, sh, prio)),
f AS (SELECT person_id, event_id AS frame, ms FROM ev WHERE zone = 'view'), n AS (SELECT x.person_id, x.kind, x.prio, x.at, (SELECT arg_min(f.frame, (abs(f.ms - x.at), f.ms, f.frame)) FROM f WHERE f.person_id = x.person_id AND abs(f.ms - x.at) <= {5 * HOUR}) AS frame FROM x)
SELECT person_id, frame, arg_min(kind, prio) AS kind, min(prio) AS priority FROM n WHERE frame IS NOT NULL GROUP BY 1, 2""")
def w18_frame_choice(spark, d):
    o = observations(spark, d)
    m = o.where("zone = 'click'").select("person_id", F.col("event_id").alias("id"), F.col("ms").alias("at"))
    f = o.where("zone = 'view'").select("person_id", F.col("event_id").alias("id"), F.col("ms").alias("at"), F.col("event_id").alias("frame"))
    return sh.frame_choice(m, f, ["person_id"], [("take", 0, 0), ("scan", 3 * HOUR, 1), ("carry", 9 * HOUR, 2)], 5 * HOUR)


@query(f"""WITH {OBS_SQL}, l AS (SELECT person_id % 8 AS lane, event_id AS id, ms, CASE WHEN event_id % 2 = 0 THEN 'TAKE' ELSE 'RETURN' END AS want FROM ev WHERE zone = 'purchase'), p AS (SELECT person_id % 8 AS lane, event_id AS id, ms AS s, ms + {HOUR} AS e, CASE event_id % 3 WHEN 0 THEN 'TAKE' WHEN 1 THEN 'RETURN' END AS got FROM ev WHERE zone = 'click'),
c AS (SELECT l.id AS label_id, p.id AS episode_id, got, row_number() OVER (PARTITION BY l.id ORDER BY CASE WHEN l.ms BETWEEN s AND e THEN 0 ELSE 1 END, greatest(s - l.ms, l.ms - e, 0), s, p.id) AS k FROM l JOIN p ON l.lane = p.lane AND s <= l.ms + {2 * HOUR} AND e >= l.ms - {2 * HOUR})
SELECT l.lane, l.id AS label_id, c.episode_id, CASE WHEN c.episode_id IS NULL THEN 'MISSED' WHEN got IS NULL THEN 'UNKNOWN' WHEN got = want THEN 'RIGHT' ELSE 'WRONG' END AS outcome FROM l LEFT JOIN c ON c.label_id = l.id AND k = 1""")
def m8_label_episodes(spark, d):
    o = observations(spark, d).withColumn("lane", F.col("person_id") % 8)
    la = o.where("zone = 'purchase'").select("lane", F.col("event_id").alias("id"), F.col("ms").alias("at"), F.when(F.col("event_id") % 2 == 0, "TAKE").otherwise("RETURN").alias("direction"))
    ep = o.where("zone = 'click'").select("lane", F.col("event_id").alias("id"), F.col("ms").alias("s"), (F.col("ms") + HOUR).alias("e"), F.when(F.col("event_id") % 3 == 0, "TAKE").when(F.col("event_id") % 3 == 1, "RETURN").alias("direction"))
    return sh.score_takes(la, ep, ["lane"], 2 * HOUR)


@query(f"""WITH {OBS_SQL}, l AS (SELECT person_id % 8 AS lane, CASE WHEN value < 20 THEN 'both' WHEN value < 50 THEN 'video' WHEN value < 90 THEN 'sensor' ELSE 'neither' END AS k FROM ev)
SELECT lane, count(*) FILTER (k = 'both') AS "both", count(*) FILTER (k = 'video') AS video, count(*) FILTER (k = 'sensor') AS sensor, count(*) FILTER (k = 'neither') AS neither, round(count(*) FILTER (k <> 'neither') / count(*), 6) AS recall FROM l GROUP BY ROLLUP (lane)""")
def a20_lane_crosstab(spark, d):
    v = F.col("value")
    k = F.when(v < 20, "both").when(v < 50, "video").when(v < 90, "sensor").otherwise("neither")
    o = observations(spark, d).select((F.col("person_id") % 8).alias("lane"), k.alias("k"))
    return o.rollup("lane").agg(*[F.count_if(F.col("k") == n).alias(n) for n in ("both", "video", "sensor", "neither")], F.round(F.count_if(F.col("k") != "neither") / F.count(F.lit(1)), 6).alias("recall"))


@query("""WITH m AS (SELECT count(*) AS n, sum(x) AS a, sum(x * x) AS b, sum(x ** 3) AS c, sum(x ** 4) AS d, sum(y) AS p, sum(x * y) AS q, sum(x * x * y) AS r FROM (SELECT l_quantity / 10 AS x, l_extendedprice / 1000 AS y FROM lineitem)),
t AS (SELECT *, n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b) AS det FROM m)
SELECT 0 AS power, round((p * (b * d - c * c) - a * (q * d - c * r) + b * (q * c - b * r)) / det, 3) AS coefficient FROM t UNION ALL SELECT 1, round((n * (q * d - c * r) - p * (a * d - b * c) + b * (a * r - q * b)) / det, 3) FROM t UNION ALL SELECT 2, round((n * (b * r - q * c) - a * (a * r - q * b) + p * (a * c - b * b)) / det, 3) FROM t""")
def a22_polynomial_fit(spark, d):
    f = sh.polynomial_fit(table(spark, d, "lineitem"), F.col("l_quantity") / 10, F.col("l_extendedprice") / 1000, 2)
    return f.withColumn("coefficient", F.round("coefficient", 3))


@query()
def d13_cross_validated(spark, d):
    """Grouped five-fold logistic regression on labelled documents, with AUC by fold; a trained model has no SQL form."""
    from ..operators.scoring import auc
    from .scoring import labelled

    x = labelled(spark, d).select("doc_id", "source", F.col("quality").cast("double").alias("y"), F.log1p("n_chars").alias("f1"), (F.col("n_chars") < 600).cast("double").alias("f2"), (F.col("lang") == "en").cast("double").alias("f3"))
    return auc(sh.cross_validated(x, "source", "y", ["f1", "f2", "f3"]), ["fold"], F.col("y") == 1, "p")


@query(f"""WITH {OBS_SQL}, a AS (SELECT person_id, event_id AS action_id, ms FROM ev WHERE zone = 'purchase'), s AS (SELECT person_id, ms, value, event_id FROM ev WHERE zone = 'view'), c AS (SELECT a.person_id, action_id, a.ms AS a0, s.ms AS t, value FROM a JOIN s ON s.person_id = a.person_id AND s.ms BETWEEN a.ms - {12 * HOUR} AND a.ms + {12 * HOUR})
SELECT person_id, action_id, arg_max(value, t) FILTER (t < a0) AS before, arg_min(value, (abs(t - a0), t)) AS mid, arg_min(value, t) FILTER (t > a0) AS after FROM c GROUP BY 1, 2""")
def d12_hand_samples(spark, d):
    o = observations(spark, d)
    a = o.where("zone = 'purchase'").select("person_id", F.col("event_id").alias("action_id"), F.col("ms").alias("at"))
    return sh.hand_samples(a, o.where("zone = 'view'").select("person_id", F.col("ms").alias("at"), "value"), ["person_id"], 12 * HOUR)


@query("""WITH b AS (SELECT l_orderkey AS file, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS source, l_returnflag AS name, l_quantity AS x, l_discount * 400 AS y, 6.0 AS w, 9.0 AS h FROM lineitem), f AS (SELECT *, min(source) OVER (PARTITION BY file) AS s FROM b), k(name, cls) AS (VALUES ('A', 0), ('N', 1))
SELECT file, cls, round((x + 3) / 60, 6) AS cx, round((y + 4.5) / 50, 6) AS cy, count(*) AS n FROM f JOIN k USING (name) WHERE source = s GROUP BY ALL""")
def d9_convert_boxes(spark, d):
    li = table(spark, d, "lineitem")
    b = li.select(F.col("l_orderkey").alias("file"), F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("source"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 400).alias("y"), F.lit(6.0).alias("w"), F.lit(9.0).alias("h"))
    classes = spark.createDataFrame([("A", 0), ("N", 1)], "name string, cls int")
    c = sh.convert_boxes(b, F.lit(60.0), F.lit(50.0), classes)
    return c.groupBy("file", "cls", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS_SQL}, o AS (SELECT person_id % 30 AS recording, person_id, count(*) FILTER (zone = 'click') - count(*) FILTER (zone = 'signup') AS net, 1 + person_id % 4 AS want, bool_or(zone = 'error') AS flagged, person_id % 9 = 0 AS culprit FROM ev GROUP BY 1, 2)
SELECT recording, count(*) AS people, count(*) FILTER (greatest(net, 0) = want) AS taken_right, count(*) FILTER (culprit AND flagged) AS culprits_hit, count(*) FILTER (culprit) AS culprits FROM o GROUP BY recording""")
def m12_human_labels(spark, d):
    z = F.col("zone")
    o = observations(spark, d).groupBy((F.col("person_id") % 30).alias("recording"), "person_id").agg((F.count_if(z == "click") - F.count_if(z == "signup")).alias("net"), F.bool_or(z == "error").alias("flagged"))
    culprit = F.col("person_id") % 9 == 0
    return o.groupBy("recording").agg(F.count(F.lit(1)).alias("people"), F.count_if(F.greatest("net", F.lit(0)) == 1 + F.col("person_id") % 4).alias("taken_right"), F.count_if(culprit & F.col("flagged")).alias("culprits_hit"), F.count_if(culprit).alias("culprits"))


@query("""SELECT user_id % 7 AS device, count(*) AS kept FROM events WHERE user_id % 7 <> 3 GROUP BY 1""")
def p1_device_filter(spark, d):
    """Foreign devices are dropped and counted by an observed metric."""
    from pyspark.sql import Observation

    seen = Observation("devices")
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("device")).observe(seen, F.count_if(F.col("device") == 3).alias("foreign"))
    return e.where("device <> 3").groupBy("device").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH b AS (SELECT l_orderkey AS image, l_linenumber AS n, l_returnflag AS name, least(greatest(l_quantity, 0), 45) AS a1, least(greatest(50 - l_quantity, 0), 45) AS a2, l_discount * 400 AS b1, l_tax * 400 AS b2 FROM lineitem)
SELECT image, n, CASE name WHEN 'A' THEN 0 ELSE 1 END AS cls, CAST(round_even(least(a1, a2), 0) AS INT) AS x1, CAST(round_even(least(b1, b2), 0) AS INT) AS y1, CAST(round_even(greatest(a1, a2), 0) AS INT) AS x2, CAST(round_even(greatest(b1, b2), 0) AS INT) AS y2 FROM b WHERE name IN ('A', 'N')""")
def p7_clean_boxes(spark, d):
    """Corners sorted, clipped and rounded; boxes of an unknown class are rejected."""
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N"))
    a1, a2 = (F.least(F.greatest(c, F.lit(0)), F.lit(45)) for c in (F.col("l_quantity"), 50 - F.col("l_quantity")))
    b1, b2 = F.col("l_discount") * 400, F.col("l_tax") * 400
    r = lambda c: F.bround(c).cast("int")
    return li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("cls"), r(F.least(a1, a2)).alias("x1"), r(F.least(b1, b2)).alias("y1"), r(F.greatest(a1, a2)).alias("x2"), r(F.greatest(b1, b2)).alias("y2"))


@query("""SELECT doc_id, regexp_extract(source, '^([a-z]+)', 1) AS letters, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS number, concat_ws('|', lang, source, CAST(doc_id // 200 AS VARCHAR)) AS take_key FROM documents""")
def x6_name_parts(spark, d):
    """Composite keys and the parts that names sort by."""
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("source", "^([a-z]+)", 1).alias("letters"), F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("number"), F.concat_ws("|", "lang", "source", F.expr("doc_id div 200").cast("string")).alias("take_key"))


@query(f"""WITH {OBS_SQL}, o AS (SELECT person_id % 10 AS pair, person_id % 10 * 1500 AS off WHERE false UNION ALL SELECT g, g * 1500 FROM range(9) t(g)) SELECT event_id, ms - off AS at_ms FROM ev JOIN o ON o.pair = person_id % 10""".replace("SELECT person_id % 10 AS pair, person_id % 10 * 1500 AS off WHERE false UNION ALL SELECT g, g * 1500 FROM", "SELECT g AS pair, g * 1500 AS off FROM"))
def x10_axis_migration(spark, d):
    """Times moved to another clock by each pair's offset; rows of a pair without one are left out."""
    off = spark.range(9).select(F.col("id").alias("pair"), (F.col("id") * 1500).alias("off"))
    return observations(spark, d).withColumn("pair", F.col("person_id") % 10).join(F.broadcast(off), "pair").select("event_id", (F.col("ms") - F.col("off")).alias("at_ms"))  # nine rows
