"""Chained decisions over the given tables: links of views, lane leases, slot episodes, lane settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import cosine
from ..operators import chains as ch
from ..operators import machines as mc
from ..sources.tables import HOUR, OBS_SQL, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def m5_link_chain(spark, d):
    """Labels of even and odd vectors are the persons of two views; windows of twenty vectors follow each other. An assignment problem: no SQL form."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 400").alias("run"), F.expr("vec_id % 400 div 20").alias("win"), (F.col("vec_id") % 2).alias("view"), "label", "vec_id", "embedding")
    one = e.groupBy("run", "win", "view", "label").agg(F.min_by("embedding", "vec_id").alias("v"), F.avg(F.col("vec_id") % 20).alias("place"))
    near = one.where("view = 0").select("run", "win", F.col("label").alias("near"), F.col("v").alias("a"), F.col("place").alias("pa"))
    far = one.where("view = 1").select("run", "win", F.col("label").alias("far"), F.col("v").alias("b"), F.col("place").alias("pb"))
    gap = F.abs(F.col("pa") - F.col("pb"))
    scored = near.join(far, ["run", "win"]).withColumn("position", F.when(gap < 12, 1 - gap / 12)).withColumn("appearance", F.greatest(cosine(F.col("a"), F.col("b")), F.lit(0.0)))
    return ch.link_windows(scored, ["run"], "win", "near", "far", "position", "appearance", solo=0.6)


_STALE = 2 * HOUR


@query(f"""WITH RECURSIVE {OBS_SQL}, r AS (
 SELECT lane, ms AS t, device, counts, row_number() OVER (PARTITION BY lane ORDER BY ms, event_id) AS k, lag(ms) OVER (PARTITION BY lane, device ORDER BY ms, event_id) AS heard
 FROM (SELECT person_id % 12 % 3 AS lane, person_id % 12 AS device, ms, event_id, zone IN ('view', 'click') AS counts FROM ev)),
m AS (
 SELECT lane, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS owner, CAST(NULL AS BIGINT) AS last, CAST([] AS BIGINT[]) AS known, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS device, CAST(NULL AS BIGINT) AS was, false AS counts FROM (SELECT DISTINCT lane FROM r)
 UNION ALL
 SELECT r.lane, r.k, CASE WHEN r.counts AND (m.owner IS NULL OR m.owner <> r.device AND r.t - m.last > {_STALE}) THEN r.device ELSE m.owner END,
        CASE WHEN m.owner = r.device OR r.counts AND (m.owner IS NULL OR r.t - m.last > {_STALE}) THEN r.t ELSE m.last END,
        CASE WHEN r.counts AND m.owner <> r.device AND r.t - m.last <= {_STALE} AND NOT list_contains(m.known, r.device) THEN list_append(m.known, r.device) ELSE m.known END,
        r.t, CASE WHEN r.counts AND m.owner <> r.device AND r.t - m.last <= {_STALE} AND NOT list_contains(m.known, r.device) THEN 'LANE_CONFLICT' WHEN r.counts AND m.owner <> r.device AND r.t - m.last > {_STALE} THEN 'LANE_OWNER_CHANGED' END,
        r.device, m.owner, r.counts
 FROM m JOIN r ON r.lane = m.lane AND r.k = m.k + 1)
SELECT lane, t AS at_ms, kind, device, was AS owner FROM m WHERE kind IS NOT NULL UNION ALL SELECT lane, t, 'ADMITTED', device, owner FROM m WHERE counts AND owner = device""")
def st16_lane_leases(spark, d):
    """ST16: four devices want each of three lanes; the owner keeps its lane until it is silent for two hours."""
    o = observations(spark, d)
    m = o.select((F.col("person_id") % 12 % 3).alias("lane"), (F.col("person_id") % 12).alias("device"), "ms", "event_id", F.col("zone").isin("view", "click").alias("measures"))
    return ch.lane_leases(m, "lane", "device", "ms", "event_id", "measures", _STALE)


@query()
def st11_slot_episodes(spark, d):
    """Five slots of each user's shelf, seen at every event; every fifth look hides some of them. Looks are compared with looks: no SQL form."""
    o = observations(spark, d)
    base = lambda k: F.pmod(F.col("person_id") * 7 + k * 13 + F.floor(F.col("ms") / (96 * HOUR)) * int(k < 3), F.lit(5))
    o = o.withColumns({f"base{k}": base(k) for k in range(5)}).withColumn("light", F.col("value") / 1000)  # shuffled with the frame, so worked out once
    looks = F.lit([[float((i + 1) * (b + 2) % 7) for i in range(24)] for b in range(5)])
    look = lambda k: F.transform(F.coalesce(F.get(looks, F.col(f"base{k}").cast("int")), F.array_repeat(F.lit(None).cast("double"), 24)), lambda x: x + F.col("light"))
    hidden = lambda k: (F.col("zone") == "error") & (F.pmod(F.col("event_id") + k, F.lit(3)) > 0)
    shown = F.array(*[F.struct(F.lit(f"slot {k}").alias("slot"), hidden(k).alias("hidden"), look(k).alias("look"), (F.col(f"base{k}") + 1).cast("double").alias("edges")) for k in range(5)])
    end = o.agg(F.max("ms")).first()[0]  # one number
    return ch.slot_episodes(o, ["person_id"], "ms", shown, end, stable=6 * HOUR)


@query()
def st18_lane_settings(spark, d):
    """Captures of three levels of thirty lanes, and the settings that follow; running medians: no SQL form."""
    o = observations(spark, d).withColumn("lane", F.col("person_id") % 30)
    level = F.col("event_id") % 3
    mm = 345.0 - F.when(level == 0, 0.0).when(level == 1, F.col("lane") % 4 * 9.0).otherwise(F.col("lane") % 4 * 9.0 + 18 + F.col("lane") % 7 * 11) + F.col("value") % 7
    s = o.select("lane", level.cast("int").alias("level"), "ms", "event_id", mm.alias("mm"))
    captured = mc.level_calibration(s, ["lane", "level"], "ms", "mm", "event_id", settle=100 * HOUR, measure=150 * HOUR, gap=200 * HOUR)
    return mc.calibrated_lanes(captured, ["lane"])
