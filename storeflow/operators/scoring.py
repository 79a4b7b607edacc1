"""Aggregates and scores: confusion tables, rates, AUC, operating curves, index quantiles, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where undefined."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def counts_with_total(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by key with subtotals; a null key is the total."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, with macro F1 and accuracy; 0 when undefined.

    One pass counts the confusion table; everything after is as small as the classes.
    """
    c = confusion(df, truth, predicted)
    side = lambda col, name, cond=None: c.groupBy(F.col(col).alias("cls")).agg(F.sum(F.when(cond, F.col("n")).otherwise(0) if cond is not None else F.col("n")).alias(name))
    t = side(truth, "support").join(side(truth, "tp", F.col(truth) == F.col(predicted)), "cls")
    p = side(predicted, "called")
    m = t.join(p, "cls", "full").select("cls", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "tp", "called")])
    m = m.withColumn("precision", ratio(F.col("tp"), F.col("called"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    m = m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    totals = m.agg(F.avg("f1").alias("macro_f1"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"))
    return m.join(F.broadcast(totals), how="cross")  # one row


def auc(df: DataFrame, keys: list[str], truth: Column, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null where a side is empty.

    Rows are first counted by distinct score, so ranks come from cumulative counts and ties share their mean rank.
    """
    g = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("pos"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    s = g.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return s.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def operating_curve(df: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """False alarm and detection rate at each threshold, from one pass; the best has the greatest difference."""
    t = df.select(truth.alias("t"), F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"), score.alias("s"))
    c = t.groupBy("threshold").agg(F.avg(F.when(~F.col("t"), (F.col("s") >= F.col("threshold")).cast("double"))).alias("false_alarm"), F.avg(F.when(F.col("t"), (F.col("s") >= F.col("threshold")).cast("double"))).alias("detection"))
    c = c.withColumn("gain", F.round(F.col("detection") - F.col("false_alarm"), 9))
    best = c.agg(F.max_by("threshold", F.struct("gain", -F.col("threshold"))).alias("best"))
    return c.join(F.broadcast(best), how="cross").withColumn("best", F.col("best") == F.col("threshold"))  # one row


def index_quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, max, mean, and the elements at n/4, n/2 and 3n/4 of the sorted values (not interpolated).

    Rows are first counted by value, so a key's window holds its distinct values only.
    """
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("_n", F.sum("_c").over(w)).withColumn("_z", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda f: F.min(F.when(F.col("_z") > F.floor(F.col("_n") * f), F.col(value)))
    return g.groupBy(*keys).agg(F.max("_n").alias("n"), F.min(value).alias("low"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max(value).alias("high"), F.round(F.sum(F.col(value) * F.col("_c")) / F.max("_n"), 6).alias("mean"))


def alert_metrics(df: DataFrame, keys: list[str], hit: Column, false: Column, duplicate: Column, latency: Column, hours: Column) -> DataFrame:
    """Detection rate, false alarms an hour, duplicates, and exact latency percentiles."""
    lat = F.when(hit, latency)
    p = lambda q: F.round(F.percentile(lat, F.lit(q)), 6)
    return df.groupBy(*keys).agg(F.round(ratio(F.count_if(hit), F.count(F.lit(1))), 6).alias("rate"), F.round(F.count_if(false) / F.max(hours), 6).alias("false_per_hour"), F.count_if(duplicate).alias("duplicates"), p(0.5).alias("p50"), F.round(F.avg(lat), 6).alias("mean"), p(0.9).alias("p90"), F.max(lat).alias("worst"))


def verdict_score(df: DataFrame, case: str, person: str, time: str, verdict: str, expected: str) -> DataFrame:
    """Last verdict of each person; a case is HIGH_RISK if any person is; scored against what was expected."""
    last = df.groupBy(case, person).agg(F.max_by(verdict, F.struct(time)).alias("v"), F.max(expected).alias("e"))
    c = last.groupBy(case).agg(F.bool_or(F.col("v") == "HIGH_RISK").alias("flagged"), F.max("e").alias("expected"), F.count(F.lit(1)).alias("people"), F.count("v").alias("decided"))
    exp = F.col("expected") == 1
    return c.withColumn("outcome", F.when(F.col("decided") == 0, "no_verdict").when(exp & F.col("flagged"), "hit").when(exp, "miss").when(F.col("flagged"), "false_alarm").otherwise("pass"))


def calibration(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, correlation, and the median absolute residual."""
    f = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))
    e = df.join(f, keys).withColumn("_e", F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")))
    m = e.groupBy(*keys).agg(F.percentile("_e", F.lit(0.5)).alias("median_error"))
    return f.join(m, keys)


def threshold_at_rate(df: DataFrame, different: Column, score: str, rate: float) -> DataFrame:
    """The score that `rate` of the different-person pairs exceed, and the share of same-person pairs above it."""
    t = df.agg(F.percentile(F.when(different, F.col(score)), F.lit(1 - rate)).alias("threshold"))
    return df.join(F.broadcast(t), how="cross").agg(F.round(F.max("threshold"), 6).alias("threshold"), F.round(F.avg(F.when(~different, (F.col(score) > F.col("threshold")).cast("double"))), 6).alias("recall"))  # one row


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key; ties take the smaller."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("modal"), F.max("_n").alias("votes"))


def coverage(presence: DataFrame, links: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Share of presence time that the union of link intervals covers. Both are (keys, s, e); links are coalesced first."""
    from .joins import overlap, range_join
    from .windows import coalesce_intervals

    lk = coalesce_intervals(links, keys, "s", "e").select(*keys, F.col("s").alias("ls"), F.col("e").alias("le"))
    j = range_join(presence, lk, keys, "s", "e", "ls", "le", bucket)
    c = j.groupBy(*keys).agg(F.sum(overlap(F.col("s"), F.col("e"), F.col("ls"), F.col("le"))).alias("covered"))
    p = presence.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("present"))
    return p.join(c, keys, "left").select(*keys, "present", F.coalesce("covered", F.lit(0)).alias("covered"), F.when(F.col("present") > 0, F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.col("present"), 6)).alias("percent"))


def class_weights(df: DataFrame, cls: str, background: str, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Background 1; actions inversely to their count, balanced among themselves, clipped."""
    c = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    mean = c.where(F.col(cls) != background).agg(F.avg("n").alias("m"))
    return c.join(F.broadcast(mean), how="cross").select(cls, "n", F.when(F.col(cls) == background, 1.0).otherwise(F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.col("m") / F.col("n"))), 6)).alias("weight"))  # one row


def track_summary(df: DataFrame, keys: list[str], frame: str, tie: str) -> DataFrame:
    """First and last frame, length, least step, gaps over the usual step, flicker."""
    w = Window.partitionBy(*keys).orderBy(frame, tie)
    d = df.withColumn("_s", F.col(frame) - F.lag(frame).over(w))
    s = d.groupBy(*keys).agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("length"), F.min("_s").alias("min_step"), F.max("_s").alias("max_step"))
    return s.withColumn("flicker", F.col("length") <= 3)
