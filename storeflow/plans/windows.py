"""Window, sequence and interval queries over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as w
from ..sources.tables import HOUR, OBS_SQL, ORDERS_SQL, observations, order_intervals

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


ISLE = "sum(new) OVER (PARTITION BY {k} ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS isle"
GAP = "CASE WHEN ms - lag(ms) OVER (PARTITION BY {k} ORDER BY ms, event_id) <= {g} THEN 0 ELSE 1 END AS new"


def _runs(keys: str, gap: int, where: str = "true") -> str:
    return f"a AS (SELECT *, {GAP.format(k=keys, g=gap)} FROM ev WHERE {where}), r AS (SELECT *, {ISLE.format(k=keys)} FROM a)"


@query(f"""WITH {OBS_SQL}, {_runs('person_id, zone', 48 * HOUR, 'value >= 20')}
SELECT person_id, zone, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS observations, max(value) AS max_overlap, min(value) AS min_speed
FROM r GROUP BY person_id, zone, isle HAVING max(ms) - min(ms) >= {12 * HOUR}""")
def w1_dwell_episodes(spark, d):
    return w.dwell_episodes(observations(spark, d), ["person_id", "zone"], "ms", "event_id", F.col("value") >= 20, 48 * HOUR, 12 * HOUR, "value", "value")


@query(f"""WITH {OBS_SQL}, {_runs('person_id', 30 * HOUR, 'value >= 5')},
f AS (SELECT *, CASE WHEN (value >= 60) IS NOT DISTINCT FROM lag(value >= 60) OVER (PARTITION BY person_id, isle ORDER BY ms, event_id) THEN 0 ELSE 1 END AS edge FROM r),
g AS (SELECT *, sum(edge) OVER (PARTITION BY person_id, isle ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS stage FROM f),
h AS (SELECT person_id, isle, min(ms) AS start_ms, max(ms) AS end_ms, max(value) AS peak FROM g WHERE value >= 60 GROUP BY person_id, isle, stage HAVING max(ms) - min(ms) >= {HOUR})
SELECT person_id, start_ms, end_ms, peak FROM (SELECT *, row_number() OVER (PARTITION BY person_id, isle ORDER BY peak DESC, start_ms) AS k FROM h) WHERE k = 1""")
def w2_staged_episodes(spark, d):
    return w.staged_episodes(observations(spark, d), ["person_id"], "ms", "event_id", F.col("value") >= 5, F.col("value") >= 60, 30 * HOUR, HOUR, "value", highest_only=True)


@query(f"""WITH {ORDERS_SQL}, a AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS new FROM iv),
b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT key, min(s) AS s, max(e) AS e, count(*) AS merged FROM b GROUP BY key, g""")
def w3_coalesce_intervals(spark, d):
    return w.coalesce_intervals(order_intervals(spark, d), ["key"], "s", "e", 2)


@query(f"""WITH {OBS_SQL}, {_runs('person_id', 5 * HOUR, "zone = 'purchase'")}
SELECT person_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS items FROM r GROUP BY person_id, isle""")
def w4_point_groups(spark, d):
    return w.point_groups(observations(spark, d).where("zone = 'purchase'"), ["person_id"], "ms", "event_id", 5 * HOUR)


@query(f"""WITH {OBS_SQL}, {_runs('person_id', 7 * HOUR)} SELECT person_id, min(ms) AS start_ms, max(ms) + 1000 AS end_ms FROM r GROUP BY person_id, isle""")
def w5_presence_segments(spark, d):
    return w.presence_segments(observations(spark, d), ["person_id"], "ms", "event_id", 7 * HOUR, 1000)


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, person_id % 10 AS track, ms - lag(ms) OVER o AS gap_ms, lag(person_id) OVER o AS person_before FROM ev WINDOW o AS (PARTITION BY person_id % 10 ORDER BY ms, event_id))
SELECT track, ms AS at_ms, gap_ms, person_before, person_id AS person_after FROM a WHERE gap_ms > {2 * HOUR}""")
def w6_revivals(spark, d):
    return w.revivals(observations(spark, d).withColumn("track", F.col("person_id") % 10), ["track"], "ms", "event_id", "person_id", 2 * HOUR)


@query(f"""WITH {OBS_SQL} SELECT person_id, ms AS born_ms, zone IN ('view', 'signup') AS at_edge FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ms, event_id) AS k FROM ev) WHERE k = 1""")
def w7_births(spark, d):
    return w.births(observations(spark, d), ["person_id"], "ms", "event_id", F.col("zone").isin("view", "signup"))


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ms, event_id) - row_number() OVER (PARTITION BY person_id, zone ORDER BY ms, event_id) AS run FROM ev)
SELECT person_id, zone, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS samples FROM a GROUP BY person_id, zone, run HAVING max(ms) - min(ms) >= {4 * HOUR}""")
def w8_zone_stays(spark, d):
    return w.zone_stays(observations(spark, d), ["person_id"], "zone", "ms", "event_id", 4 * HOUR)


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, CASE WHEN value >= 30 THEN zone END AS partner FROM ev),
b AS (SELECT *, last_value(partner IGNORE NULLS) OVER (PARTITION BY person_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_partner FROM a)
SELECT person_id, ms AS at_ms, old_partner, partner AS new_partner FROM b WHERE partner <> old_partner""")
def w9_partner_switches(spark, d):
    o = observations(spark, d).withColumn("partner", F.when(F.col("value") >= 30, F.col("zone")))
    return w.partner_switches(o, ["person_id"], "ms", "event_id", "partner")


_LINKS = f"""{OBS_SQL}, l AS (SELECT person_id % 20 AS id, ms // {24 * HOUR} AS win, CASE WHEN count(*) % 2 = 0 THEN 'A' ELSE 'B' END AS p FROM ev GROUP BY 1, 2)"""


@query(f"""WITH {_LINKS}, a AS (SELECT *, lag(p, 1) OVER o AS p1, lag(p, 2) OVER o AS p2, lag(win, 2) OVER o AS w2 FROM l WINDOW o AS (PARTITION BY id ORDER BY win)),
b AS (SELECT * FROM a WHERE p1 = p2 AND p <> p1 AND w2 = win - 2)
SELECT x.win AS "window", x.id AS first_id, y.id AS second_id, x.p1 AS first_old, x.p AS first_new FROM b x JOIN b y ON x.win = y.win AND x.p1 = y.p AND x.p = y.p1 AND x.id < y.id""")
def w10_mutual_swaps(spark, d):
    links = observations(spark, d).groupBy((F.col("person_id") % 20).alias("id"), F.floor(F.col("ms") / (24 * HOUR)).alias("win")).agg(F.when(F.count(F.lit(1)) % 2 == 0, "A").otherwise("B").alias("p"))
    return w.mutual_swaps(links, "id", "win", "p")


@query(f"""WITH {OBS_SQL}, a AS (SELECT event_id, person_id, ms, value, value AS x, value / 2 AS y,
 coalesce(last_value({{'t': ms, 'x': value}}) OVER (PARTITION BY person_id ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND {6 * HOUR} PRECEDING),
          first_value({{'t': ms, 'x': value}}) OVER (PARTITION BY person_id ORDER BY ms ROWS UNBOUNDED PRECEDING)) AS p FROM ev)
SELECT event_id, person_id, CASE WHEN ms > p.t THEN round(sqrt((x - p.x) ** 2 + (y - p.x / 2) ** 2) / 100.0 / ((ms - p.t) / 1000.0), 9) END AS speed FROM a""")
def w11_trailing_speed(spark, d):
    o = observations(spark, d).withColumn("x", F.col("value")).withColumn("y", F.col("value") / 2).withColumn("h", F.lit(100.0))
    return w.trailing_speed(o, ["person_id"], "ms", "x", "y", "h", 6 * HOUR).select("event_id", "person_id", F.round("speed", 9).alias("speed"))


@query(f"""WITH {OBS_SQL}, e AS (SELECT person_id, ms - {2 * HOUR} AS e_start, ms + {HOUR} AS e_end, zone AS label FROM ev WHERE zone IN ('purchase', 'error')),
a AS (SELECT DISTINCT person_id, (ms // {3 * HOUR} + 1) * {3 * HOUR} AS anchor FROM ev),
j AS (SELECT a.*, label, e_start, least(anchor, e_end) - greatest(anchor - {4 * HOUR}, e_start) AS shared, e_end - e_start AS len FROM a JOIN e USING (person_id) WHERE e_start <= anchor AND e_end >= anchor - {4 * HOUR}),
b AS (SELECT person_id, anchor, label, row_number() OVER (PARTITION BY person_id, anchor ORDER BY shared DESC, e_start, label DESC) AS k FROM j WHERE shared >= {2 * HOUR} OR shared >= 0.8 * len)
SELECT a.person_id, a.anchor, coalesce(b.label, 'background') AS label FROM a LEFT JOIN b ON a.person_id = b.person_id AND a.anchor = b.anchor AND b.k = 1""")
def w12_clip_windows(spark, d):
    o = observations(spark, d)
    ev = o.where(F.col("zone").isin("purchase", "error")).select("person_id", (F.col("ms") - 2 * HOUR).alias("e_start"), (F.col("ms") + HOUR).alias("e_end"), F.col("zone").alias("label"))
    anchors = o.select("person_id", ((F.floor(F.col("ms") / (3 * HOUR)) + 1) * (3 * HOUR)).alias("anchor")).distinct()
    return w.clip_windows(anchors, ev, ["person_id"], 4 * HOUR)


@query(f"""WITH {OBS_SQL}, a AS (SELECT event_id, zone, person_id % 7 AS actor, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ms END AS t FROM ev),
b AS (SELECT *, row_number() OVER o AS k, CASE WHEN t IS NULL OR t - lag(t) OVER o > {3 * HOUR} THEN 1 ELSE 0 END AS n FROM a WINDOW o AS (PARTITION BY zone, actor ORDER BY t NULLS LAST, event_id))
SELECT event_id, zone, actor, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE n END) OVER (PARTITION BY zone, actor ORDER BY t NULLS LAST, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS take_no FROM b""")
def w13_take_clusters(spark, d):
    o = observations(spark, d).select("event_id", "zone", (F.col("person_id") % 7).alias("actor"), F.when(F.col("event_id") % 11 != 0, F.col("ms")).alias("t"))
    return w.take_clusters(o, ["zone", "actor"], "t", "event_id", 3 * HOUR).select("event_id", "zone", "actor", "take_no")


@query(f"""WITH {OBS_SQL} SELECT event_id, person_id, CASE WHEN zone <> 'view' THEN CAST(sum(CASE WHEN zone <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS seq FROM ev""")
def w14_renumber(spark, d):
    return w.renumber(observations(spark, d), ["person_id"], ["ms", "event_id"], F.col("zone") != "view").select("event_id", "person_id", "seq")


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, (ms - min(ms) OVER (PARTITION BY person_id)) // {12 * HOUR} AS slot FROM ev)
SELECT event_id, person_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY person_id, slot ORDER BY ms, event_id) AS k FROM a) WHERE k = 1""")
def w15_grid_sample(spark, d):
    return w.grid_sample(observations(spark, d), ["person_id"], "ms", "event_id", 12 * HOUR).select("event_id", "person_id", "ms")


@query(f"""WITH RECURSIVE {OBS_SQL}, p AS (
  SELECT person_id, min(ms) AS t, 1 AS n, [min(ms)] AS picks FROM ev GROUP BY person_id
  UNION ALL
  SELECT p.person_id, x.t, n + 1, list_append(picks, x.t) FROM p, LATERAL (SELECT min(ms) AS t FROM ev WHERE ev.person_id = p.person_id AND ev.ms >= p.t + {36 * HOUR}) x WHERE n < 8 AND x.t IS NOT NULL)
SELECT person_id, CASE WHEN n = 8 THEN array_to_string(picks, ',') END AS picks FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY n DESC) AS k FROM p) WHERE k = 1""")
def w16_greedy_spacing(spark, d):
    return w.greedy_spacing(observations(spark, d), ["person_id"], "ms", 36 * HOUR, 8).withColumn("picks", F.array_join("picks", ","))


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY person_id) AS n FROM ev)
SELECT event_id, person_id FROM a WHERE n <= 12 OR i IN (SELECT k * n // 12 FROM range(12) t(k))""")
def w17_even_thinning(spark, d):
    return w.even_thinning(observations(spark, d), ["person_id"], ["ms", "event_id"], 12).select("event_id", "person_id")


@query(f"""WITH {OBS_SQL}, p AS (SELECT zone, person_id, count(*) AS n, max(ms) AS last_ms FROM ev GROUP BY 1, 2)
SELECT zone, person_id, n, row_number() OVER (PARTITION BY zone ORDER BY n DESC, person_id) AS turn FROM p""")
def w19_round_robin(spark, d):
    p = observations(spark, d).groupBy("zone", "person_id").agg(F.count(F.lit(1)).alias("n"))
    return w.round_robin(p, "zone", [F.desc("n"), "person_id"])


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, lag(zone) OVER o = zone AND ms - lag(ms) OVER o < {6 * HOUR} AS again FROM ev WINDOW o AS (PARTITION BY person_id ORDER BY ms, event_id))
SELECT event_id, person_id, zone, ms FROM a WHERE NOT coalesce(again, false)""")
def w20_scan_gate(spark, d):
    return w.scan_gate(observations(spark, d), ["person_id"], "ms", "event_id", "zone", 6 * HOUR).select("event_id", "person_id", "zone", "ms")


_DEV = f"""{OBS_SQL}, m AS (SELECT event_id, person_id % 5 AS boot, ms AS host, CAST(ms - round(value * 10) AS BIGINT) AS dev FROM ev)"""


def _messages(spark, d):
    return observations(spark, d).select("event_id", (F.col("person_id") % 5).alias("boot"), F.col("ms").alias("host"), (F.col("ms") - F.round(F.col("value") * 10)).cast("bigint").alias("dev"))


@query(f"""WITH {_DEV}, a AS (SELECT *, coalesce((host - lag(host) OVER o) - (dev - lag(dev) OVER o) * CAST(1.001 AS DOUBLE), 0.0) AS step FROM m WINDOW o AS (PARTITION BY boot ORDER BY host, event_id)),
b AS (SELECT *, sum(step) OVER (PARTITION BY boot ORDER BY host, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a),
c AS (SELECT *, round(s - least(0.0, min(s) OVER (PARTITION BY boot ORDER BY host, event_id ROWS UNBOUNDED PRECEDING)), 3) AS l FROM b)
SELECT event_id, boot, round(l, 0) AS late_ms, l > 1000 AS late FROM c""")
def w21_arrival_lateness(spark, d):
    return w.arrival_lateness(_messages(spark, d), ["boot"], ["host", "event_id"], "host", "dev", 1000.0).select("event_id", "boot", F.round("late_ms", 0).alias("late_ms"), "late")


@query(f"""WITH {_DEV}, a AS (SELECT *, dev % 4294967296 AS clock FROM m), b AS (SELECT *, ((clock - lag(clock) OVER (PARTITION BY boot ORDER BY host, event_id)) % 4294967296 + 4294967296) % 4294967296 AS delta FROM a)
SELECT event_id, boot, CAST(coalesce(sum(CASE WHEN delta < 2147483648 THEN delta ELSE 0 END) OVER (PARTITION BY boot ORDER BY host, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS mono_ms FROM b""")
def w22_unwrap_clock(spark, d):
    m = _messages(spark, d).withColumn("clock", F.pmod("dev", F.lit(1 << 32)))
    return w.unwrap_clock(m, ["boot"], ["host", "event_id"], "clock").select("event_id", "boot", "mono_ms")


@query(f"""WITH {_DEV}, a AS (SELECT *, event_id // 3 + event_id % 4 AS seq FROM m), b AS (SELECT *, max(seq) OVER (PARTITION BY boot ORDER BY host, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a)
SELECT event_id, boot, CASE WHEN top IS NULL THEN 'first' WHEN seq <= top THEN 'duplicate' WHEN seq > top + 1 THEN 'gap' ELSE 'ok' END AS status, CASE WHEN seq > top + 1 THEN seq - top - 1 ELSE 0 END AS missing FROM b""")
def w23_sequence_quality(spark, d):
    m = _messages(spark, d).withColumn("seq", F.expr("event_id div 3 + event_id % 4"))
    return w.sequence_quality(m, ["boot"], ["host", "event_id"], "seq").select("event_id", "boot", "status", "missing")


@query(f"""WITH {OBS_SQL}, s AS (SELECT *, min(ms) OVER p AS lo, max(ms) OVER p AS hi FROM ev WINDOW p AS (PARTITION BY person_id)),
b AS (SELECT person_id, CASE WHEN hi = lo THEN 0 ELSE least((ms - lo) * 32 // (hi - lo), 31) END AS bin, max(value) AS peak FROM s GROUP BY 1, 2)
SELECT person_id, CAST(bin AS INTEGER) AS bin, peak, CASE WHEN lag(bin) OVER o = bin - 1 THEN least(peak, lag(peak) OVER o) END AS sustained FROM b WINDOW o AS (PARTITION BY person_id ORDER BY bin)""")
def w24_binned_max(spark, d):
    return w.binned_max(observations(spark, d), ["person_id"], "ms", "value", 32)


_LAGS = list(range(-6 * HOUR, 6 * HOUR + 1, 2 * HOUR))


@query(f"""WITH {OBS_SQL}, g AS (SELECT unnest({_LAGS}) AS lag_ms),
a AS (SELECT lag_ms, ms // {4 * HOUR} AS s, avg(value) AS va FROM ev, g WHERE zone = 'view' GROUP BY 1, 2),
b AS (SELECT lag_ms, CAST(floor((ms + lag_ms) / {4.0 * HOUR}) AS BIGINT) AS s, avg(value) AS vb FROM ev, g WHERE zone = 'click' GROUP BY 1, 2),
c AS (SELECT lag_ms, avg(abs(va - vb)) AS cost, count(*) AS pairs, corr(va, vb) AS r FROM a JOIN b USING (lag_ms, s) GROUP BY 1)
SELECT lag_ms, round(cost, 6) AS cost, pairs, round(r, 6) AS corr, row_number() OVER (ORDER BY cost, lag_ms) = 1 AS best,
 round(CASE WHEN lag(cost) OVER o - 2 * cost + lead(cost) OVER o > 0 THEN 0.5 * (lag(cost) OVER o - lead(cost) OVER o) / (lag(cost) OVER o - 2 * cost + lead(cost) OVER o) * {2 * HOUR} ELSE 0 END, 2) AS refine FROM c WINDOW o AS (ORDER BY lag_ms)""")
def w25_lag_search(spark, d):
    o = observations(spark, d).withColumn("site", F.lit(1))
    c = w.lag_search(o.where("zone = 'view'"), o.where("zone = 'click'"), ["site"], "ms", "value", _LAGS, 4 * HOUR)
    return c.select("lag_ms", F.round("cost", 6).alias("cost"), "pairs", F.round("corr", 6).alias("corr"), "best", F.round(w.parabolic_shift(F.col("before"), F.col("cost"), F.col("after"), 2 * HOUR), 2).alias("refine"))


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, CASE WHEN lag(zone) OVER o = zone AND ms - lag(ms) OVER o <= {24 * HOUR} THEN 0 ELSE 1 END AS new FROM ev WINDOW o AS (PARTITION BY person_id ORDER BY ms, event_id)),
r AS (SELECT *, {ISLE.format(k='person_id')} FROM a) SELECT person_id, zone, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS windows FROM r GROUP BY person_id, zone, isle""")
def w29_link_spans(spark, d):
    return w.link_spans(observations(spark, d), ["person_id"], "ms", "event_id", "zone", 24 * HOUR)


@query(f"""WITH {OBS_SQL}, l AS (SELECT *, max(CASE WHEN zone = 'click' THEN ms END) OVER (PARTITION BY person_id) AS last_ms FROM ev)
SELECT person_id, any_value(last_ms) AS last_inside_ms, max(value) AS recent_max FROM l WHERE ms BETWEEN last_ms - {48 * HOUR} AND last_ms GROUP BY person_id""")
def w30_recent_max(spark, d):
    return w.recent_max(observations(spark, d), ["person_id"], "ms", F.col("zone") == "click", "value", 48 * HOUR)
