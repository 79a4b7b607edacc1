"""Ledger, verdict, case, cart, alert and lane queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lg
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


DELAY = 1500
_ACTS = f"""{OBS_SQL}, act AS (SELECT person_id, CASE WHEN zone = 'purchase' THEN ms ELSE ms + {DELAY} END AS t, CASE zone WHEN 'click' THEN 1 WHEN 'signup' THEN -1 ELSE 0 END AS taken, CASE WHEN zone = 'purchase' THEN 1 ELSE 0 END AS paid FROM ev WHERE zone IN ('click', 'signup', 'purchase')),
ex AS (SELECT event_id AS exit_id, person_id, ms FROM ev WHERE zone = 'error')"""
_AS_OF = "greatest(coalesce((SELECT sum(taken) FROM act a WHERE a.person_id = x.person_id AND a.t <= x.ms + {h}), 0), 0) AS taken, coalesce((SELECT sum(paid) FROM act a WHERE a.person_id = x.person_id AND a.t <= x.ms + {h}), 0) AS paid"
_LEVEL = "CASE WHEN taken > paid AND paid = 0 THEN 'HIGH_RISK' WHEN taken > paid THEN 'REVIEW' ELSE 'CLEAR' END"


def actions(spark, d):
    o = observations(spark, d).where(F.col("zone").isin("click", "signup", "purchase"))
    z = F.col("zone")
    return o.select("person_id", F.when(z == "purchase", F.col("ms")).otherwise(F.col("ms") + DELAY).alias("ms"), F.when(z == "click", 1).when(z == "signup", -1).otherwise(0).cast("bigint").alias("taken"), (z == "purchase").cast("bigint").alias("paid"))


def exits(spark, d, later: int = 0):
    return observations(spark, d).where("zone = 'error'").select("person_id", (F.col("ms") + later).alias("ms"), F.col("event_id").alias("exit_id"))


@query(f"""WITH {_ACTS}, s AS (SELECT exit_id, person_id, ms, {_AS_OF.format(h=0)} FROM ex x)
SELECT exit_id, person_id, ms, CAST(taken AS BIGINT) AS taken, CAST(paid AS BIGINT) AS paid, CAST(greatest(taken - paid, 0) AS BIGINT) AS unpaid, {_LEVEL} AS level FROM s""")
def exit_verdicts(spark, d):
    """Flagship: each exit judged by the ledger as it is known at that moment (A14, X17, ST5)."""
    return lg.ledger_as_of(actions(spark, d), exits(spark, d), "person_id", "ms")


@query(f"""WITH {_ACTS}, s AS (SELECT exit_id, person_id, {_AS_OF.format(h=0)} FROM ex x), r AS (SELECT exit_id AS rid, {_AS_OF.format(h=6 * HOUR)} FROM ex x),
a AS (SELECT exit_id, person_id, {_LEVEL} AS level FROM s), b AS (SELECT rid, {_LEVEL} AS final_level, CAST(greatest(taken - paid, 0) AS BIGINT) AS final_unpaid FROM r)
SELECT exit_id, person_id, level, CASE WHEN level = 'HIGH_RISK' THEN 'WARNING' ELSE level END AS shown, final_level, final_unpaid FROM a JOIN b ON rid = exit_id""")
def st7_hold_and_release(spark, d):
    acts = actions(spark, d)
    now = lg.ledger_as_of(acts, exits(spark, d), "person_id", "ms").select("exit_id", "person_id", "level")
    return lg.hold_and_release(now, lg.ledger_as_of(acts, exits(spark, d, 6 * HOUR), "person_id", "ms"))


@query(f"""WITH {_ACTS}, s AS (SELECT exit_id, person_id, ms, {_AS_OF.format(h=0)} FROM ex x), a AS (SELECT *, {_LEVEL} AS level FROM s),
c AS (SELECT a.exit_id, a.person_id, a.level, (SELECT max(value) / 100.0 FROM ev WHERE ev.person_id = a.person_id AND zone = 'view' AND ev.ms BETWEEN a.ms - {12 * HOUR} AND a.ms) AS consistency FROM a)
SELECT exit_id, person_id, CASE WHEN level = 'HIGH_RISK' AND consistency < 0.78 THEN 'REVIEW' ELSE level END AS gated, CASE WHEN level = 'HIGH_RISK' AND consistency < 0.78 THEN 'identity uncertain' WHEN level = 'HIGH_RISK' AND consistency IS NULL THEN 'identity not checked' END AS note FROM c""")
def st8_swap_gate(spark, d):
    """The greatest consistency in the window before an exit decides whether HIGH_RISK may stand."""
    from ..operators.joins import range_join

    v = exit_verdicts(spark, d)
    win = v.select("person_id", "exit_id", (F.col("ms") - 12 * HOUR).alias("s"), F.col("ms").alias("e"))
    seen = observations(spark, d).where("zone = 'view'").select("person_id", F.col("ms").alias("vs"), F.col("ms").alias("ve"), (F.col("value") / 100.0).alias("c"))
    best = range_join(win, seen, ["person_id"], "s", "e", "vs", "ve", 12 * HOUR).groupBy("exit_id").agg(F.max("c").alias("consistency"))
    return lg.swap_gate(v.join(best, "exit_id", "left"), "level", "consistency").select("exit_id", "person_id", "gated", "note")


@query(f"""WITH {OBS_SQL}, e AS (SELECT *, lead(ms) OVER (PARTITION BY person_id ORDER BY ms, event_id) AS back FROM ev), z AS (SELECT max(ms) AS t FROM ev)
SELECT person_id, ms AS exit_ms, CASE WHEN back - ms >= {5 * HOUR} THEN 'confirmed' WHEN back IS NOT NULL THEN 'retracted' WHEN t - ms >= {5 * HOUR} THEN 'confirmed' ELSE 'open' END AS outcome, back AS back_ms FROM e, z WHERE zone = 'error'""")
def st5_exit_outcome(spark, d):
    """ST4 to ST6: exits confirmed by absence, retracted by a return, or open at the end of the stream."""
    o = observations(spark, d)
    end = o.agg(F.max("ms").alias("stream_end"))
    return lg.exit_outcome(o.join(F.broadcast(end), how="cross"), "person_id", "ms", "event_id", F.col("zone") == "error", 5 * HOUR, F.col("stream_end"))  # one row


@query(f"""WITH {_ACTS}, s AS (SELECT person_id, ms AS end_ms, greatest(coalesce((SELECT sum(taken) FROM act a WHERE a.person_id = x.person_id AND a.t <= x.ms), 0), 0) AS taken FROM ev x WHERE zone = 'view' AND value >= 60)
SELECT person_id, end_ms, CAST(taken AS BIGINT) AS taken, CAST(greatest(taken - coalesce(max(taken) OVER (PARTITION BY person_id ORDER BY end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS BIGINT) AS pays FROM s""")
def st12_dwell_payments(spark, d):
    stays = observations(spark, d).where("zone = 'view' and value >= 60").select("person_id", F.col("ms").alias("end_ms"))
    return lg.dwell_payments(stays, actions(spark, d).where("taken <> 0").withColumnRenamed("ms", "known_at"), "person_id")


_CASE = f"""WITH RECURSIVE {OBS_SQL}, e AS (SELECT person_id, CASE zone WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE -1 END AS r, zone = 'purchase' AS x, row_number() OVER (PARTITION BY person_id ORDER BY ms, event_id) AS k FROM ev),
f AS (SELECT person_id, 0 AS k, -1 AS level, 'none' AS state, 0 AS notified, 0 AS reopened FROM (SELECT DISTINCT person_id FROM e)
 UNION ALL SELECT f.person_id, e.k,
  CASE WHEN e.x OR e.r < 0 THEN f.level WHEN f.level < 0 OR e.r > f.level THEN e.r WHEN e.r = 0 AND f.level = 1 AND f.state <> 'resolved' THEN 0 ELSE f.level END,
  CASE WHEN e.x AND f.level >= 0 THEN 'resolved' WHEN e.x OR e.r < 0 THEN f.state WHEN f.level < 0 THEN CASE WHEN e.r > 0 THEN 'active' ELSE 'pass' END WHEN e.r > f.level THEN 'active' WHEN e.r = 0 AND f.level = 1 AND f.state <> 'resolved' THEN 'auto_cleared' ELSE f.state END,
  f.notified + CASE WHEN NOT e.x AND e.r > greatest(f.level, 0) THEN 1 ELSE 0 END,
  f.reopened + CASE WHEN NOT e.x AND f.level >= 0 AND e.r > f.level AND f.state = 'resolved' THEN 1 ELSE 0 END
 FROM f JOIN e ON e.person_id = f.person_id AND e.k = f.k + 1),
c AS (SELECT person_id, ['CLEAR', 'WARNING', 'REVIEW', 'HIGH_RISK'][level + 1] AS level, state, notified, reopened FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY k DESC) AS z FROM f) WHERE z = 1 AND level >= 0)"""


def levels(o):
    """Alarm levels and resolutions of observations."""
    z = F.col("zone")
    return o.withColumn("level", F.when(z == "view", "CLEAR").when(z == "click", "WARNING").when(z == "signup", "REVIEW").when(z == "error", "HIGH_RISK")).withColumn("resolution", F.when(z == "purchase", "ok"))


def cases(spark, d):
    return lg.case_fold(levels(observations(spark, d)), ["person_id"], ["ms", "event_id"], "level", "resolution")


@query(_CASE + " SELECT * FROM c")
def st3_case_fold(spark, d):
    return cases(spark, d)


@query(_CASE + " SELECT person_id, CASE WHEN state = 'active' AND notified > 0 THEN 'show' WHEN reopened > 0 AND state <> 'active' THEN 'cancel' ELSE 'none' END AS action, state = 'active' AS listed, state <> 'pass' AS in_all FROM c")
def st20_notifications(spark, d):
    """ST20 and P16: what a phone does with each case, and the lists it belongs to."""
    c = cases(spark, d)
    return c.select("person_id", lg.notification(F.col("state"), F.col("notified"), F.col("reopened") > 0).alias("action"), (F.col("state") == "active").alias("listed"), (F.col("state") != "pass").alias("in_all"))


@query(f"""WITH {OBS_SQL}, o AS (SELECT *, CASE zone WHEN 'view' THEN 'add' WHEN 'click' THEN 'set' WHEN 'signup' THEN 'remove' WHEN 'error' THEN 'clear' ELSE 'checkout' END AS kind, event_id % 4 AS item, CAST(floor(value) AS BIGINT) % 5 AS qty FROM ev),
s AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('clear', 'checkout') THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cart_no FROM o),
l AS (SELECT person_id, cart_no, item, list_reduce(list(CASE kind WHEN 'add' THEN -1 WHEN 'remove' THEN 0 ELSE qty END ORDER BY ms, event_id), lambda a, c: CASE WHEN c = -1 THEN greatest(a, 1) WHEN c = 0 THEN 0 WHEN a > 0 THEN c ELSE 0 END, CAST(0 AS BIGINT)) AS qty FROM s WHERE kind IN ('add', 'set', 'remove') GROUP BY 1, 2, 3)
SELECT l.person_id, CAST(l.cart_no AS BIGINT) AS cart_no, l.item, l.qty, coalesce(e.kind, 'open') AS closed_by FROM l LEFT JOIN s e ON e.person_id = l.person_id AND e.cart_no = l.cart_no AND e.kind IN ('clear', 'checkout') WHERE l.qty > 0""")
def st15_cart_sessions(spark, d):
    z = F.col("zone")
    o = observations(spark, d).withColumn("kind", F.when(z == "view", "add").when(z == "click", "set").when(z == "signup", "remove").when(z == "error", "clear").otherwise("checkout")).withColumn("item", F.col("event_id") % 4).withColumn("q", F.floor("value") % 5)
    return lg.cart_lines(o, "person_id", ["ms", "event_id"], "kind", "item", "q")


@query(f"""WITH {OBS_SQL} SELECT person_id, event_id, zone, value FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ms DESC, event_id DESC) AS k FROM ev) WHERE k = 1""")
def st19_latest_wins(spark, d):
    return lg.latest(observations(spark, d), ["person_id"], ["ms", "event_id"]).select("person_id", "event_id", "zone", "value")


@query(f"""WITH {OBS_SQL}, n AS (SELECT person_id % 20 AS device, ms, lead(ms) OVER (PARTITION BY person_id % 20 ORDER BY ms, event_id) AS nx FROM ev) SELECT device, ms + {3 * HOUR} AS stale_ms, nx AS restored_ms FROM n WHERE nx - ms > {3 * HOUR}""")
def st16_stale_devices(spark, d):
    return lg.stale_spans(observations(spark, d).withColumn("device", F.col("person_id") % 20), ["device"], "ms", "event_id", 3 * HOUR)


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, value > 60 AS f, coalesce(lag(value > 60) OVER (PARTITION BY person_id ORDER BY ms, event_id), false) AS b FROM ev) SELECT event_id, person_id, CASE WHEN f THEN 'start' ELSE 'end' END AS edge FROM a WHERE f <> b""")
def st24_backlog_edges(spark, d):
    return lg.edges(observations(spark, d), ["person_id"], ["ms", "event_id"], F.col("value") > 60).select("event_id", "person_id", "edge")


@query(f"""WITH {OBS_SQL}, w AS (SELECT *, ms // {24 * HOUR} AS day FROM ev), l AS (SELECT *, row_number() OVER (PARTITION BY person_id, day ORDER BY ms DESC, event_id DESC) AS k, max(CASE WHEN value >= 5 THEN ms END) OVER (PARTITION BY person_id, day) AS valid FROM w)
SELECT person_id, day, zone AS state, value, (day + 1) * {24 * HOUR} - ms > {8 * HOUR} AS stale, (day + 1) * {24 * HOUR} - valid AS since_valid FROM l WHERE k = 1""")
def st22_status_snapshots(spark, d):
    """Latest state of each lane at the end of each day, with staleness."""
    o = observations(spark, d).withColumn("day", F.floor(F.col("ms") / (24 * HOUR)))
    s = o.groupBy("person_id", "day").agg(F.max_by(F.struct("zone", "value", "ms"), F.struct("ms", "event_id")).alias("s"), F.max(F.when(F.col("value") >= 5, F.col("ms"))).alias("valid"))
    end = (F.col("day") + 1) * (24 * HOUR)
    return s.select("person_id", "day", F.col("s.zone").alias("state"), "s.value", (end - F.col("s.ms") > 8 * HOUR).alias("stale"), (end - F.col("valid")).alias("since_valid"))


@query(f"""WITH RECURSIVE {OBS_SQL}, e AS (SELECT person_id, ms, value / 100.0 AS s, row_number() OVER (PARTITION BY person_id ORDER BY ms, event_id) AS k FROM ev),
f AS (SELECT person_id, 0 AS k, CAST([] AS BOOLEAN[]) AS recent, CAST(NULL AS BIGINT) AS started, CAST(NULL AS DOUBLE) AS peak, 0 AS hits, 0 AS below, CAST(-1 AS BIGINT) AS until, CAST(NULL AS BIGINT) AS e_start, CAST(NULL AS BIGINT) AS e_end, CAST(NULL AS DOUBLE) AS e_peak, 0 AS e_hits FROM (SELECT DISTINCT person_id FROM e)
UNION ALL
SELECT g.person_id, k, CASE WHEN ends THEN CAST([] AS BOOLEAN[]) ELSE r END, CASE WHEN ends THEN NULL WHEN begins THEN ms ELSE started END, CASE WHEN ends THEN NULL WHEN begins THEN s WHEN started IS NOT NULL THEN greatest(peak, s) END,
 CASE WHEN ends THEN 0 WHEN begins THEN n WHEN started IS NOT NULL THEN hits + CAST(hit AS INT) ELSE 0 END, CASE WHEN ends OR begins OR hit OR started IS NULL THEN 0 ELSE below + 1 END, CASE WHEN ends THEN ms + {20 * HOUR} ELSE until END,
 CASE WHEN ends THEN started END, CASE WHEN ends THEN ms END, CASE WHEN ends THEN greatest(peak, s) END, CASE WHEN ends THEN hits ELSE 0 END
FROM (SELECT *, started IS NULL AND ms >= until AND n >= 3 AS begins FROM (SELECT f.person_id, e.k, e.ms, e.s, f.started, f.peak, f.hits, f.below, f.until, e.s >= 0.4 AS hit, list_append(f.recent, e.s >= 0.4)[-5:] AS r, len(list_filter(list_append(f.recent, e.s >= 0.4)[-5:], lambda b: b)) AS n, f.started IS NOT NULL AND e.s < 0.4 AND f.below + 1 >= 4 AS ends FROM f JOIN e ON e.person_id = f.person_id AND e.k = f.k + 1)) g),
z AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY k DESC) AS q FROM f)
SELECT person_id, e_start AS start_ms, e_end AS end_ms, e_peak AS peak, CAST(e_hits AS INTEGER) AS hits FROM f WHERE e_end IS NOT NULL UNION ALL SELECT person_id, started, NULL, peak, CAST(hits AS INTEGER) FROM z WHERE q = 1 AND started IS NOT NULL""")
def st2_alert_intervals(spark, d):
    o = observations(spark, d).withColumn("score", F.col("value") / 100.0)
    return mc.alert_intervals(o, "person_id", "ms", "event_id", "score", threshold=0.4, window=5, min_hits=3, end_below=4, cooldown=20 * HOUR)


REFS = [160.0, 120.0, 80.0, 40.0, 0.0]


@query()
def st1_lane_events(spark, d):
    """ST1 and ST17: counts of each lane from noisy distances, restocking suppressed. Recursive: no SQL form."""
    k = F.col("event_id")
    o = observations(spark, d).withColumn("mm", F.when(k % 50 != 0, F.col("value") % 200)).withColumn("restock", k % 40 < 2).withColumn("status", F.when(k % 300 == 7, "MUX_ERROR")).withColumn("late", k % 90 == 5)
    return mc.lane_events(o, "person_id", "ms", "event_id", "mm", REFS, restock="restock", status="status", late="late", tolerance=(15.0, 60.0, 60.0, 60.0, 60.0), hysteresis=5.0, stable_ms=6 * HOUR, min_samples=2, spread=60.0, median=2, max_gap=48 * HOUR, resync_gap=72 * HOUR, error_after=2, error_ms=96 * HOUR, high=190.0)


@query()
def st18_level_calibration(spark, d):
    """Median level of the first undisturbed stretch of each user's lane. Recursive: no SQL form."""
    o = observations(spark, d).withColumn("mm", F.col("value") % 50)
    return mc.level_calibration(o, ["person_id"], "ms", "mm", "event_id", settle=120 * HOUR, measure=200 * HOUR, gap=200 * HOUR, spread=30.0)


@query("""WITH a AS (SELECT l_orderkey AS visit, l_linenumber AS n, CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INT) % 3 ELSE 0 END AS removed, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) % 3 ELSE 0 END AS added, CASE l_linenumber WHEN 1 THEN 'DECREASED' WHEN 2 THEN 'INCREASED' WHEN 3 THEN 'CHANGED' END AS dir, l_linestatus = 'F' AS covered, l_quantity * 3 AS delta, l_linenumber % 3 * 10 AS unit FROM lineitem)
SELECT visit, n, CASE WHEN removed > 0 AND added > 0 THEN 'MOVE' WHEN removed > 0 THEN 'TAKE' WHEN added > 0 THEN 'RETURN' WHEN dir = 'DECREASED' THEN 'TAKE' WHEN dir = 'INCREASED' THEN 'RETURN' WHEN dir = 'CHANGED' THEN 'TOUCH' WHEN covered THEN 'TOUCH' ELSE 'LOOK' END AS kind, CASE WHEN unit > 0 THEN greatest(1, CAST(round_even(delta / unit, 0) AS INT)) ELSE 1 END AS units FROM a""")
def x15_visit_kinds(spark, d):
    """What each shelf visit was, and how many items its weight stands for."""
    q, f, n = F.col("l_quantity").cast("int") % 3, F.col("l_returnflag"), F.col("l_linenumber")
    li = table(spark, d, "lineitem")
    kind = lg.visit_kind(F.when(f == "A", q).otherwise(0), F.when(f == "R", q).otherwise(0), F.when(n == 1, "DECREASED").when(n == 2, "INCREASED").when(n == 3, "CHANGED"), F.col("l_linestatus") == "F")
    return li.select(F.col("l_orderkey").alias("visit"), n.alias("n"), kind.alias("kind"), lg.sensor_units(F.col("l_quantity") * 3, n % 3 * 10).alias("units"))


_SET = "list_sort(list_distinct([x FOR x IN [{a}] IF x IS NOT NULL]))"


@query("""WITH a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [user_id % 9] WHEN event_id % 4 = 1 THEN [user_id % 9, user_id % 7 + 20] ELSE [] END AS reach, CASE WHEN event_id % 7 = 0 THEN user_id % 5 + 40 END AS link, CASE WHEN event_id % 3 = 0 THEN [user_id % 9] WHEN event_id % 3 = 1 THEN [user_id % 9, 99] ELSE [] END AS touch, CASE WHEN event_id % 5 = 0 THEN [user_id % 3] ELSE [] END AS band FROM events)
SELECT event_id, CASE WHEN len(reach) = 1 THEN reach[1] WHEN link IS NOT NULL THEN link WHEN len(touch) = 1 THEN touch[1] WHEN len(list_intersect(touch, reach)) = 1 THEN list_intersect(touch, reach)[1] WHEN len(band) = 1 THEN band[1] ELSE -1 END AS owner,
 CASE WHEN len(reach) = 1 THEN 'reach' WHEN link IS NOT NULL THEN 'link' WHEN len(touch) = 1 THEN 'touch' WHEN len(list_intersect(touch, reach)) = 1 THEN 'touch_reach' WHEN len(band) = 1 THEN 'band' ELSE 'unknown' END AS how FROM a""")
def j21_owner_cascade(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    none = F.array().cast("array<bigint>")
    a = table(spark, d, "events").select(
        "event_id", F.when(e % 4 == 0, F.array(u % 9)).when(e % 4 == 1, F.array(u % 9, u % 7 + 20)).otherwise(none).alias("reach"), F.when(e % 7 == 0, u % 5 + 40).alias("link"),
        F.when(e % 3 == 0, F.array(u % 9)).when(e % 3 == 1, F.array(u % 9, F.lit(99).cast("bigint"))).otherwise(none).alias("touch"), F.when(e % 5 == 0, F.array(u % 3)).otherwise(none).alias("band"),
    )
    owner, how = lg.owner_cascade(F.col("reach"), F.col("link"), F.col("touch"), F.col("band"))
    return a.select("event_id", owner.alias("owner"), how.alias("how"))


@query("""SELECT o_custkey AS person_id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT)) AS BIGINT) AS net, CAST(greatest(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS taken, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS paid FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def a14_customer_ledger(spark, d):
    """Orders as customers' takes and returns; finished orders are paid."""
    q = F.col("l_quantity").cast("bigint")
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    net = F.sum(F.when(F.col("l_returnflag") == "R", -q).otherwise(q))
    return j.groupBy(F.col("o_custkey").alias("person_id")).agg(net.alias("net"), F.greatest(net, F.lit(0)).alias("taken"), F.sum(F.when(F.col("o_orderstatus") == "F", q).otherwise(0)).alias("paid"))


@query("""SELECT o_custkey AS person_id, count(*) FILTER (o_orderpriority LIKE '1%') AS high, count(*) FILTER (o_orderstatus = 'P') AS retractions, count(*) AS visits, coalesce(array_to_string(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'O'), ','), '') AS open_list FROM orders GROUP BY o_custkey""")
def a37_ledger_summary(spark, d):
    s = F.col("o_orderstatus")
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("high"), F.count_if(s == "P").alias("retractions"), F.count(F.lit(1)).alias("visits"), F.array_sort(F.collect_list(F.when(s == "O", F.col("o_orderkey")))).alias("open_list"))
    return g.withColumn("open_list", F.array_join("open_list", ","))
