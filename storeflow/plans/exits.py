"""Exit and checkout machines over events: hours stand for the machines' seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exits as ex
from ..sources.tables import HOUR, OBS_SQL, observations

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


#: Stays of 2 hours at the exit or outside, gone after 10 hours unseen, visits end after 6 hours.
LEAST, CONFIRM, REARM, HOLD = 2 * HOUR, 10 * HOUR, 6 * HOUR, 20 * HOUR


def sightings(spark, d):
    """Each event is a sighting: an error at the exit, a signup outside, the others inside. A click takes, a purchase pays."""
    z = F.col("zone")
    return observations(spark, d).select(
        "person_id", "ms", "event_id", (z == "error").alias("at_exit"), (z == "signup").alias("outside"), F.lit(None).cast("boolean").alias("inside"), F.lit(None).cast("double").alias("look"), F.lit(False).alias("edge"),
        (z == "click").cast("bigint").alias("taken"), (z == "purchase").cast("bigint").alias("paid"), (z == "purchase").alias("checkout"), F.when(z == "view", F.col("value") / 100).otherwise(0.0).alias("overlap"),
    )


_LEVEL = "CASE WHEN {t} <= {p} THEN 'CLEAR' WHEN {p} > 0 THEN 'REVIEW' ELSE 'HIGH_RISK' END"
_EXITS = f"""WITH RECURSIVE {OBS_SQL}, z AS (SELECT max(ms) AS last FROM ev), r AS (
 SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY ms, event_id) AS k, ms AS t, zone = 'error' AS ex, zone = 'signup' AS ou, CAST(zone = 'click' AS BIGINT) AS dt, CAST(zone = 'purchase' AS BIGINT) AS dp FROM ev),
m AS (
 SELECT person_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS paid, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS near, CAST(NULL AS BIGINT) AS stay, CAST(NULL AS BIGINT) AS lft, false AS warned, CAST(NULL AS BIGINT) AS street, false AS came, false AS gone,
        CAST(NULL AS BIGINT) AS e_van, CAST(0 AS BIGINT) AS van_t, CAST(0 AS BIGINT) AS van_p, false AS e_back, false AS e_warn, false AS e_out, CAST(NULL AS BIGINT) AS t
 FROM (SELECT DISTINCT person_id FROM r)
 UNION ALL
 SELECT person_id, k, taken, paid, t, near, stay, lft, w2, street, came, g1 OR o2, e_van, van_t, van_p, e_back, x2 AND taken > 0 AND paid = 0, o2, t FROM (
  SELECT *, x2 OR w1 AS w2, NOT g1 AND came AND street IS NOT NULL AND t - street >= {LEAST} AS o2 FROM (
   SELECT *, stay IS NOT NULL AND NOT w1 AND came AND t - stay >= {LEAST} AS x2 FROM (
    SELECT person_id, k, t, taken, paid, e_van, van_t, van_p, e_back, g1, CASE WHEN ex OR ou THEN t ELSE near END AS near, CASE WHEN ou THEN coalesce(street, t) END AS street, came OR NOT ou AS came,
           CASE WHEN ex THEN coalesce(s0, t) END AS stay, CASE WHEN ex THEN NULL WHEN s0 IS NOT NULL THEN t ELSE l0 END AS lft, w0 AND NOT (ex AND s0 IS NULL AND l0 IS NOT NULL AND t - l0 >= {REARM}) AS w1
    FROM (
     SELECT *, g0 AND ou AS g1, g0 AND NOT ou AS e_back, CASE WHEN g0 AND NOT ou THEN NULL ELSE stay END AS s0, CASE WHEN g0 AND NOT ou THEN NULL ELSE lft END AS l0, warned AND NOT (g0 AND NOT ou) AS w0 FROM (
      SELECT r.person_id, r.k, r.t, r.ex, r.ou, m.taken + r.dt AS taken, m.paid + r.dp AS paid, m.taken AS van_t, m.paid AS van_p, m.near, m.stay, m.lft, m.warned, m.street, m.came,
             CASE WHEN m.came AND NOT m.gone AND m.near IS NOT NULL AND m.seen - m.near <= {REARM} AND r.t - m.seen > {CONFIRM} THEN m.seen + {CONFIRM} END AS e_van,
             m.gone OR coalesce(m.came AND m.near IS NOT NULL AND m.seen - m.near <= {REARM} AND r.t - m.seen > {CONFIRM}, false) AS g0
      FROM m JOIN r ON r.person_id = m.person_id AND r.k = m.k + 1)))))),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY k DESC) = 1),
o AS (
 SELECT person_id, e_van AS at_ms, 'vanished' AS cause, van_t AS taken, van_p AS paid FROM m WHERE e_van IS NOT NULL
 UNION ALL SELECT person_id, t, 'retracted', taken, paid FROM m WHERE e_back
 UNION ALL SELECT person_id, t, 'approach', taken, paid FROM m WHERE e_warn
 UNION ALL SELECT person_id, t, 'outside', taken, paid FROM m WHERE e_out
 UNION ALL SELECT person_id, CASE WHEN last - seen >= {CONFIRM} THEN seen + {CONFIRM} ELSE last END, CASE WHEN last - seen >= {CONFIRM} THEN 'vanished' ELSE 'end' END, taken, paid FROM f, z WHERE came AND NOT gone AND near IS NOT NULL AND seen - near <= {REARM} AND last - seen >= 300)
SELECT person_id, at_ms, CASE cause WHEN 'retracted' THEN NULL WHEN 'approach' THEN 'WARNING' ELSE {_LEVEL.format(t="taken", p="paid")} END AS level, cause, taken, paid, greatest(taken - paid, 0) AS unpaid FROM o"""


@query(_EXITS)
def st4_exit_machine(spark, d):
    """ST4 to ST6: warnings at the exit, verdicts outside, by vanishing and at the end, and retractions, for every person."""
    rows = sightings(spark, d)
    end = rows.agg(F.max("ms")).first()[0]  # one number
    return ex.exit_events(rows, "person_id", "ms", "event_id", end=end, least=LEAST, confirm=CONFIRM, rearm=REARM).drop("note")


_TILL = f"""WITH RECURSIVE {OBS_SQL}, r AS (
 SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY ms, event_id) AS k, ms AS t, zone = 'purchase' AS co, CASE WHEN zone = 'view' THEN value / 100 ELSE 0 END AS lap, CAST(zone = 'click' AS BIGINT) AS dt FROM ev),
m AS (
 SELECT person_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS dwelt, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS t, CAST(0 AS BIGINT) AS items, CAST(NULL AS VARCHAR) AS kind FROM (SELECT DISTINCT person_id FROM r)
 UNION ALL
 SELECT person_id, k, taken, CASE WHEN pays THEN greatest(dwelt, taken) WHEN back THEN 0 ELSE dwelt END, since, last, t,
        CASE WHEN pays THEN greatest(taken - dwelt, 0) WHEN back THEN -dwelt ELSE 0 END, CASE WHEN pays AND taken > dwelt THEN CASE WHEN dwelt = 0 THEN 'dwell' ELSE 'more' END WHEN back THEN 'cancel' END
 FROM (SELECT *, NOT pays AND dwelt > 0 AND lap >= 0.5 AS back FROM (
  SELECT *, coalesce(since IS NOT NULL AND t - since >= 3 * {HOUR}, false) AS pays FROM (
   SELECT r.person_id, r.k, r.t, r.lap, m.taken + r.dt AS taken, m.dwelt, CASE WHEN r.co THEN coalesce(m.since, r.t) WHEN r.t - m.last <= 4 * {HOUR} THEN m.since END AS since, CASE WHEN r.co THEN r.t ELSE m.last END AS last
   FROM m JOIN r ON r.person_id = m.person_id AND r.k = m.k + 1))))
SELECT person_id, t AS at_ms, items, kind FROM m WHERE kind IS NOT NULL"""


@query(_TILL)
def st12_dwell_cancel(spark, d):
    """ST12: standing at the checkout pays what is held, going back to a shelf cancels it, and standing there again pays anew."""
    rows = sightings(spark, d).withColumn("paid", F.lit(0).cast("bigint"))
    return ex.dwell_events(rows, "person_id", "ms", "event_id", pay=3 * HOUR, back=0.5, grace=4 * HOUR)
