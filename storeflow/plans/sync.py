"""Lags and identity maps between two views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import matching as mt
from ..operators import sync as sy
from ..sources.tables import HOUR, OBS_SQL, observations, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _views(spark, d):
    """Lines as boxes of two recordings: a run for every 20 suppliers, a person for each line number, a frame a key; the least line counts."""
    li = table(spark, d, "lineitem")
    x, y = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 300
    b = li.select((F.col("l_suppkey") % 20).alias("run"), (F.col("l_orderkey") % 2).alias("view"), F.expr("l_orderkey div 2").alias("frame"), F.col("l_linenumber").cast("bigint").alias("person"), F.struct("l_partkey", "l_quantity").alias("k"), g.box(x, y, x + 20 + F.col("l_linenumber"), y + 15).alias("b"))
    one = b.groupBy("run", "view", "frame", "person").agg(F.min_by("b", "k").alias("b"))
    return one.where("view = 0"), one.where("view = 1")


@query("""WITH l AS (SELECT l_suppkey % 20 AS run, l_orderkey % 2 AS view, l_orderkey // 2 AS frame, CAST(l_linenumber AS BIGINT) AS person, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) * 300 AS y1, CAST(l_quantity AS DOUBLE) + 20 + l_linenumber AS x2, CAST(l_discount AS DOUBLE) * 300 + 15 AS y2, l_partkey, l_quantity FROM lineitem),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY run, view, frame, person ORDER BY l_partkey, l_quantity) = 1),
p AS (SELECT t.run, t.person AS old_id, r.person AS new_id, t.frame, greatest(least(t.x2, r.x2) - greatest(t.x1, r.x1), 0) * greatest(least(t.y2, r.y2) - greatest(t.y1, r.y1), 0) / ((t.x2 - t.x1) * (t.y2 - t.y1)) AS share, row_number() OVER (PARTITION BY t.run, t.person, t.frame, r.person ORDER BY abs(r.frame - t.frame), r.frame) AS k
 FROM b t JOIN b r ON t.run = r.run AND t.view = 1 AND r.view = 0 AND r.frame BETWEEN t.frame - 2 AND t.frame + 2)
SELECT run, old_id, new_id, round(sum(share), 5) AS score FROM p WHERE k = 1 GROUP BY 1, 2, 3""")
def m7_overlap_scores(spark, d):
    """How much of each person's boxes the persons of the other recording cover, in the nearest of five frames."""
    a, b = _views(spark, d)
    return sy.identity_overlap(a, b, ["run"], "frame", "person", "b").withColumn("score", F.round("score", 5))


@query()
def m7_overlap_map(spark, d):
    """These scores as a map, one to one, greatest first; greedy: no SQL form."""
    return mt.greedy_map(m7_overlap_scores(spark, d), ["run"], "old_id", "new_id", "score", 1.0)


_STEP, _TOL = 2 * HOUR, HOUR
_LAGS = list(range(-8 * HOUR, 8 * HOUR + 1, _STEP))
_PAIRS = f"""{OBS_SQL}, s AS (SELECT person_id % 6 AS pair, ms, event_id, zone, value FROM ev), g AS (SELECT unnest(CAST({_LAGS} AS BIGINT[])) AS lag_ms),
n AS (SELECT a.pair, a.event_id AS ai, lag_ms, b.event_id AS bi, a.value AS av, b.value AS bv, row_number() OVER (PARTITION BY a.event_id, lag_ms ORDER BY abs(b.ms - a.ms - lag_ms), b.ms, b.event_id DESC) AS k
 FROM s a, g JOIN s b ON b.zone = 'click' AND b.pair = a.pair AND b.ms BETWEEN a.ms + lag_ms - {_TOL} AND a.ms + lag_ms + {_TOL} WHERE a.zone = 'view')"""


@query(f"""WITH {_PAIRS}, d AS (SELECT pair, lag_ms, least(sqrt((av % 100 - bv % 100) ** 2 + (ai % 50 - bi % 50) ** 2), 90) AS u, least(sqrt((av % 100 + 30 - bv % 100) ** 2 + (ai % 50 - bi % 50) ** 2), 90) AS v FROM n WHERE k = 1),
c AS (SELECT pair, lag_ms, avg((u + v + least(u, v)) / 3) AS cost, count(*) AS pairs FROM d GROUP BY 1, 2 HAVING count(*) >= 20),
o AS (SELECT *, CASE WHEN lag_ms - lag(lag_ms) OVER w = {_STEP} THEN lag(cost) OVER w END AS y0, CASE WHEN lead(lag_ms) OVER w - lag_ms = {_STEP} THEN lead(cost) OVER w END AS y2 FROM c WINDOW w AS (PARTITION BY pair ORDER BY lag_ms)),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY pair ORDER BY cost, lag_ms) = 1),
f AS (SELECT c.pair, c.lag_ms, c.cost FROM c JOIN b USING (pair) WHERE abs(c.lag_ms - b.lag_ms) > {3 * HOUR} QUALIFY row_number() OVER (PARTITION BY c.pair ORDER BY c.cost, c.lag_ms) = 1),
r AS (SELECT b.pair, b.lag_ms + coalesce(CASE WHEN y0 - 2 * b.cost + y2 > 0 THEN 0.5 * (y0 - y2) / (y0 - 2 * b.cost + y2) * {_STEP} ELSE 0 END, 0) AS off, b.cost, b.pairs, coalesce((f.cost + 5) / (b.cost + 5), 0) AS sharpness, f.lag_ms AS second_ms FROM b LEFT JOIN f USING (pair))
SELECT pair, round(off, 2) AS offset_ms, round(cost, 6) AS cost, pairs, round(sharpness, 6) AS sharpness, second_ms, pairs >= 40 AND sharpness >= 1.02 AND cost <= 60 AS ok,
       array_to_string([x FOR x IN [CASE WHEN pairs < 40 THEN 'few pairs' END, CASE WHEN sharpness < 1.02 THEN 'flat' END, CASE WHEN cost > 60 THEN 'far apart' END] IF x IS NOT NULL], ';') AS reasons FROM r""")
def w25_floor_lag(spark, d):
    """The lag at which the floor points of two views lie nearest, with its sharpness; two points in one view, one in the other."""
    o = observations(spark, d).withColumn("pair", F.col("person_id") % 6)
    at = lambda extra: F.struct((F.col("value") % 100 + extra).alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    a = o.where("zone = 'view'").withColumn("points", F.array(at(0.0), at(30.0)))
    b = o.where("zone = 'click'").withColumn("points", F.array(at(0.0)))
    curve = sy.floor_lags(a, b, ["pair"], "ms", "event_id", "points", _LAGS, tolerance=_TOL, cap=90.0)
    best = sy.best_lag(curve, ["pair"], _STEP, exclude=3 * HOUR, sure=(40, 1.02, 60.0))
    return best.select("pair", F.round("offset_ms", 2).alias("offset_ms"), F.round("cost", 6).alias("cost"), "pairs", F.round("sharpness", 6).alias("sharpness"), "second_ms", "ok", "reasons")


@query(f"""WITH {_PAIRS}, c AS (SELECT pair, lag_ms, abs(corr(av, bv)) AS r, count(*) AS pairs FROM n WHERE k = 1 GROUP BY 1, 2 HAVING count(*) >= 20),
b AS (SELECT * FROM c WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(r, 9) DESC, lag_ms) = 1),
e AS (SELECT p.pair, lag_ms, r, coalesce(pairs, 0) AS pairs, coalesce(pairs, 0) >= 60 AND coalesce(r, 0) >= 0.12 AS good FROM (SELECT DISTINCT pair FROM s WHERE zone = 'view') p LEFT JOIN b USING (pair)),
m AS (SELECT coalesce(quantile_cont(lag_ms, 0.5) FILTER (good), 0) AS mid FROM e)
SELECT pair, CASE WHEN good THEN lag_ms ELSE mid END AS offset_ms, CASE WHEN good THEN 'trajectory' ELSE 'trajectory-fallback' END AS method, lag_ms AS found_ms, round(r, 6) AS r, pairs FROM e, m""")
def w26_correlation_lag(spark, d):
    """W26 and W27's fallback: the lag of the greatest correlation, and the median of the believed lags for the others."""
    o = observations(spark, d).withColumn("pair", F.col("person_id") % 6)
    c = sy.correlation_lags(o.where("zone = 'view'"), o.where("zone = 'click'"), ["pair"], "ms", "event_id", "value", _LAGS, _TOL, least=0.12)
    return c.withColumn("r", F.round("r", 6))
