"""Two recordings of one scene: which ids are the same, and how far their clocks are apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, intersection
from .joins import nearest_in_time, top_one
from .windows import parabolic_shift


def identity_overlap(reference: DataFrame, target: DataFrame, keys: list[str], frame: str, person: str, box: str, reach: int = 2) -> DataFrame:
    """(keys, old_id, new_id, score): over all frames of a target person the shared part of its box with the reference person's
    box in the nearest frame within `reach` (of two as near, the earlier), summed. One box a person and frame."""
    steps = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(step).cast("bigint").alias("step")) for rank, step in enumerate(sorted(range(-reach, reach + 1), key=lambda s: (abs(s), s)))])
    t = target.select(*keys, F.col(person).alias("old_id"), F.col(frame).alias("_f"), F.col(box).alias("_t"), F.explode(steps).alias("_o"))
    t = t.withColumn(frame, F.col("_f") + F.col("_o.step"))
    r = reference.select(*keys, F.col(frame), F.col(person).alias("new_id"), F.col(box).alias("_r"))
    near = t.join(r, [*keys, frame]).groupBy(*keys, "old_id", "_f", "new_id").agg(F.min_by(F.struct("_t", "_r"), "_o.rank").alias("_b"))
    share = F.when(area(F.col("_b._t")) > 0, intersection(F.col("_b._t"), F.col("_b._r")) / area(F.col("_b._t"))).otherwise(F.lit(0.0))
    return near.groupBy(*keys, "old_id", "new_id").agg(F.sum(share).alias("score"))


def chamfer(p: Column, q: Column, cap: float) -> Column:
    """Mean distance of each point of two arrays (x, y) to the nearest of the other, capped."""
    apart = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    one_way = lambda us, vs: F.aggregate(F.transform(us, lambda a: F.least(F.array_min(F.transform(vs, lambda b: apart(a, b))), F.lit(float(cap)))), F.lit(0.0), lambda s, x: s + x)
    return (one_way(p, q) + one_way(q, p)) / (F.size(p) + F.size(q))


def lagged_pairs(a: DataFrame, b: DataFrame, keys: list[str], time: str, ident: str, value: str, lags: list[int], tolerance: int) -> DataFrame:
    """(keys, lag_ms, a, b): each sample of a with the sample of b nearest to its time plus each lag, within the tolerance.

    Samples of a are repeated by the grid of lags, which is a parameter; b is not: one sort a key.
    """
    n = len(lags)
    grid = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(x).cast("bigint").alias("lag")) for i, x in enumerate(lags)]))
    moved = a.select(*keys, time, ident, value, grid.alias("_g")).select(*keys, (F.col(time) + F.col("_g.lag")).alias(time), (F.col(ident) * n + F.col("_g.i")).alias(ident), F.col(value).alias("a"), F.col("_g.lag").alias("lag_ms"))
    near = nearest_in_time(moved, b, keys, time, ident, value, tolerance).where("dt_ms is not null").select(*keys, ident, F.col(f"near_{value}").alias("b"))
    return moved.join(near, [*keys, ident]).select(*keys, "lag_ms", "a", "b")


def floor_lags(a: DataFrame, b: DataFrame, keys: list[str], time: str, ident: str, points: str, lags: list[int], *, tolerance: int = 25, cap: float = 150.0, least_pairs: int = 20) -> DataFrame:
    """(keys, lag_ms, cost, pairs) of the lags that enough samples support; samples hold arrays of floor points, empty ones don't count."""
    p = lagged_pairs(a.where(F.size(points) > 0), b, keys, time, ident, points, lags, tolerance).where(F.size("b") > 0)
    return p.groupBy(*keys, "lag_ms").agg(F.avg(chamfer(F.col("a"), F.col("b"), cap)).alias("cost"), F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") >= least_pairs)


def best_lag(curve: DataFrame, keys: list[str], step: int, *, exclude: int = 500, noise: float = 5.0, sure: tuple[int, float, float] = (40, 1.2, 60.0)) -> DataFrame:
    """The cheapest lag of each key (ties: the first), refined by a parabola where both neighbours are there, and how sure it is.

    sharpness: the cheapest cost over `exclude` away, over the best, each plus `noise`; 0 without one. ok: pairs, sharpness and
    cost keep the limits of `sure`; reasons tell which do not.
    """
    w = Window.partitionBy(*keys).orderBy("lag_ms")
    side = lambda f: F.when(F.abs(f("lag_ms").over(w) - F.col("lag_ms")) == step, f("cost").over(w))
    c = curve.withColumn("_before", side(F.lag)).withColumn("_after", side(F.lead))
    best = top_one(c, keys, [F.col("cost"), F.col("lag_ms")]).withColumnRenamed("lag_ms", "_at")
    far = curve.join(best.select(*keys, "_at"), keys).where(F.abs(F.col("lag_ms") - F.col("_at")) > exclude)
    second = top_one(far, keys, [F.col("cost"), F.col("lag_ms")]).select(*keys, F.col("lag_ms").alias("second_ms"), F.col("cost").alias("_second"))
    j = best.join(second, keys, "left")
    j = j.withColumn("offset_ms", F.col("_at") + F.coalesce(parabolic_shift(F.col("_before"), F.col("cost"), F.col("_after"), step), F.lit(0.0)))
    j = j.withColumn("sharpness", F.coalesce((F.col("_second") + noise) / (F.col("cost") + noise), F.lit(0.0)))
    why = F.array_compact(F.array(F.when(F.col("pairs") < sure[0], "few pairs"), F.when(F.col("sharpness") < sure[1], "flat"), F.when(F.col("cost") > sure[2], "far apart")))
    return j.select(*keys, "offset_ms", "cost", "pairs", "sharpness", "second_ms", (F.size(why) == 0).alias("ok"), F.array_join(why, ";").alias("reasons"))


def correlation_lags(a: DataFrame, b: DataFrame, keys: list[str], time: str, ident: str, value: str, lags: list[int], tolerance: int, *, floor: int = 20, samples: int = 60, least: float = 0.6) -> DataFrame:
    """The lag at which two courses go together most (greatest size of correlation over at least `floor` pairs; ties: the first lag).

    Where it has fewer than `samples` pairs or a correlation under `least` it is not believed, and the median of the believed lags of
    all keys takes its place (0 if there is none). Keys without any lag are not believed either.
    """
    p = lagged_pairs(a, b, keys, time, ident, value, lags, tolerance)
    c = p.groupBy(*keys, "lag_ms").agg(F.covar_pop("a", "b").alias("_c"), F.count(F.lit(1)).alias("pairs"), F.stddev_pop("a").alias("_a"), F.stddev_pop("b").alias("_b"))
    c = c.where((F.col("pairs") >= floor) & (F.col("_a") >= 1e-3) & (F.col("_b") >= 1e-3))
    c = c.withColumn("r", F.abs(F.try_divide(F.col("_c"), F.col("_a") * F.col("_b")))).where("r > 0")
    best = top_one(c.withColumn("_r", F.round("r", 9)), keys, [F.desc("_r"), F.col("lag_ms")])
    every = a.select(*keys).distinct().join(best, keys, "left")
    good = (F.coalesce("pairs", F.lit(0)) >= samples) & (F.coalesce("r", F.lit(0.0)) >= least)
    middle = every.where(good).agg(F.coalesce(F.percentile("lag_ms", F.lit(0.5)), F.lit(0.0)).alias("_middle"))
    out = every.withColumn("_good", good).join(F.broadcast(middle), how="cross")  # one row
    return out.select(*keys, F.when(F.col("_good"), F.col("lag_ms").cast("double")).otherwise(F.col("_middle")).alias("offset_ms"), F.when(F.col("_good"), "trajectory").otherwise("trajectory-fallback").alias("method"), F.col("lag_ms").alias("found_ms"), "r", F.coalesce("pairs", F.lit(0)).alias("pairs"))
