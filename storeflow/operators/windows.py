"""Window, sequence and interval operators. Times are bigint milliseconds unless a column says otherwise.

Every operator partitions by its keys and needs one shuffle on them; operators that share keys share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_checkpoint
from .joins import range_join


def _by(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: `new` marks a row that starts one (it may look back with lag over the same order)."""
    w = _by(keys, *order)
    return df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(new.cast("int"), F.lit(0)))).withColumn(name, F.sum("_new").over(w)).drop("_new")


def gap_islands(df: DataFrame, keys: list[str], time: str, tie: str, gap: int, name: str = "island") -> DataFrame:
    """Runs whose consecutive times are at most `gap` apart."""
    w = _by(keys, time, tie)
    return islands(df, keys, [time, tie], (F.col(time) - F.lag(time).over(w)) > gap, name)


def dwell_episodes(obs: DataFrame, keys: list[str], time: str, tie: str, qualifies: Column, gap: int, dwell: int, peak: str, low: str) -> DataFrame:
    """Stretches of qualifying samples without a gap over `gap` that last at least `dwell`, with peak, low and count."""
    runs = gap_islands(obs.where(qualifies), keys, time, tie, gap)
    out = runs.groupBy(*keys, "island").agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count(F.lit(1)).alias("observations"), F.max(peak).alias("max_overlap"), F.min(low).alias("min_speed"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= dwell).drop("island")


def staged_episodes(obs: DataFrame, keys: list[str], time: str, tie: str, qualifies: Column, raised: Column, gap: int, min_stage: int, peak: str, highest_only: bool = False) -> DataFrame:
    """Runs of raised samples inside a qualifying dwell; keep those of at least `min_stage`, or each dwell's highest peak."""
    runs = gap_islands(obs.where(qualifies), keys, time, tie, gap, "dwell")
    w = _by([*keys, "dwell"], time, tie)
    flagged = runs.withColumn("_r", raised.cast("int")).withColumn("_edge", F.coalesce(F.lag("_r").over(w) != F.col("_r"), F.lit(True)).cast("int")).withColumn("stage", F.sum("_edge").over(w))
    out = flagged.where("_r = 1").groupBy(*keys, "dwell", "stage").agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.max(peak).alias("peak"))
    out = out.where(F.col("end_ms") - F.col("start_ms") >= min_stage)
    if highest_only:
        best = Window.partitionBy(*keys, "dwell").orderBy(F.desc("peak"), "start_ms")
        out = out.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    return out.drop("dwell", "stage")


def coalesce_intervals(iv: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Merge while a start is at most the running maximum end plus `gap`. Unknown starts and ends come last and merge with nothing by themselves."""
    w = _by(keys, F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = iv.withColumn("_new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    equals, each = F.sum("_new").over(w), F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # equal intervals that reach themselves are one run, in whatever order they come; others all begin one, or none does
    runs = d.withColumn("island", F.when(F.col(start) <= F.col(end) + gap, equals).otherwise(each))
    return runs.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("merged")).drop("island")


def point_groups(points: DataFrame, keys: list[str], time: str, tie: str, gap: int) -> DataFrame:
    """Groups of points no more than `gap` apart: first and last time, size."""
    return gap_islands(points, keys, time, tie, gap).groupBy(*keys, "island").agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count(F.lit(1)).alias("items")).drop("island")


def presence_segments(obs: DataFrame, keys: list[str], time: str, tie: str, gap: int, step: int) -> DataFrame:
    """Segments joined over gaps up to `gap`; each ends one step after its last sample."""
    return point_groups(obs, keys, time, tie, gap).select(*keys, "start_ms", (F.col("end_ms") + step).alias("end_ms"))


def revivals(obs: DataFrame, keys: list[str], time: str, tie: str, person: str, silent: int) -> DataFrame:
    """Places where a track was silent for longer than `silent`: the gap, and the person before and after."""
    w = _by(keys, time, tie)
    d = obs.withColumn("gap_ms", F.col(time) - F.lag(time).over(w)).withColumn("person_before", F.lag(person).over(w))
    return d.where(F.col("gap_ms") > silent).select(*keys, F.col(time).alias("at_ms"), "gap_ms", "person_before", F.col(person).alias("person_after"))


def births(obs: DataFrame, keys: list[str], time: str, tie: str, edge: Column) -> DataFrame:
    """First row of each key, with a flag whether it was at an edge."""
    return obs.withColumn("_k", F.row_number().over(_by(keys, time, tie))).where("_k = 1").select(*keys, F.col(time).alias("born_ms"), edge.alias("at_edge"))


def zone_stays(obs: DataFrame, keys: list[str], zone: str, time: str, tie: str, least: int) -> DataFrame:
    """Maximal runs of consecutive samples in one zone that last at least `least`."""
    a, b = F.row_number().over(_by(keys, time, tie)), F.row_number().over(_by([*keys, zone], time, tie))
    runs = obs.withColumn("_run", a - b)
    out = runs.groupBy(*keys, zone, "_run").agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count(F.lit(1)).alias("samples"))
    return out.where(F.col("end_ms") - F.col("start_ms") >= least).drop("_run")


def partner_switches(links: DataFrame, keys: list[str], time: str, tie: str, partner: str) -> DataFrame:
    """Rows whose partner differs from the last known one (null partners are skipped over)."""
    w = _by(keys, time, tie)
    before = F.last(partner, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = links.withColumn("old_partner", before)
    return d.where(F.col(partner).isNotNull() & F.col("old_partner").isNotNull() & (F.col(partner) != F.col("old_partner"))).select(*keys, F.col(time).alias("at_ms"), "old_partner", F.col(partner).alias("new_partner"))


def mutual_swaps(links: DataFrame, ident: str, window: str, partner: str) -> DataFrame:
    """Two ids that exchange partners at a window, after each held its old one for two windows (A, A -> B against B, B -> A)."""
    w = Window.partitionBy(ident).orderBy(window)
    d = links.withColumn("p1", F.lag(partner, 1).over(w)).withColumn("p2", F.lag(partner, 2).over(w)).withColumn("w2", F.lag(window, 2).over(w))
    d = d.where((F.col("p1") == F.col("p2")) & (F.col(partner) != F.col("p1")) & (F.col("w2") == F.col(window) - 2)).select(F.col(window).alias("w"), F.col(ident).alias("i"), F.col("p1").alias("old"), F.col(partner).alias("new"))
    a, b = d.alias("a"), d.alias("b")
    hit = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.old") == F.col("b.new")) & (F.col("a.new") == F.col("b.old")) & (F.col("a.i") < F.col("b.i")))
    return hit.select(F.col("a.w").alias("window"), F.col("a.i").alias("first_id"), F.col("b.i").alias("second_id"), F.col("a.old").alias("first_old"), F.col("a.new").alias("first_new"))


def trailing_speed(obs: DataFrame, keys: list[str], time: str, x: str, y: str, height: str, window: int) -> DataFrame:
    """Displacement since the last sample at least `window` old (else the oldest), per body height and second."""
    far = Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -window)
    all_ = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    point = F.struct(F.col(time).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    d = obs.withColumn("_p", F.coalesce(F.last(point).over(far), F.first(point).over(all_)))
    dt = (F.col(time) - F.col("_p.t")) / 1000.0
    dist = F.sqrt(F.pow(F.col(x) - F.col("_p.x"), 2) + F.pow(F.col(y) - F.col("_p.y"), 2))
    return d.withColumn("speed", F.when(dt > 0, dist / F.col(height) / dt)).drop("_p")


def renumber(rows: DataFrame, keys: list[str], order: list[str], counted: Column) -> DataFrame:
    """1..n in order among counted rows; 0 for the others."""
    w = _by(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("seq", F.when(counted, F.sum(counted.cast("int")).over(w)).otherwise(F.lit(0)))


def grid_sample(rows: DataFrame, keys: list[str], time: str, tie: str, period: int) -> DataFrame:
    """The first row of each period, counted from the key's first time."""
    first = F.min(time).over(Window.partitionBy(*keys))
    d = rows.withColumn("_slot", F.floor((F.col(time) - first) / period))
    return d.withColumn("_k", F.row_number().over(_by([*keys, "_slot"], time, tie))).where("_k = 1").drop("_k", "_slot")


def greedy_spacing(rows: DataFrame, keys: list[str], time: str, spacing: int, want: int) -> DataFrame:
    """Per key the first `want` picks that are `spacing` apart, each as early as possible; null where there are fewer.

    A fold over the key's sorted times; keys are tracks with a bounded number of samples.
    """
    times = F.array_sort(F.collect_list(time))
    step = lambda acc, t: F.when((F.size(acc) < want) & ((F.size(acc) == 0) | (t >= F.element_at(acc, -1) + spacing)), F.concat(acc, F.array(t))).otherwise(acc)
    picks = rows.groupBy(*keys).agg(times.alias("_t")).withColumn("_p", F.aggregate("_t", F.array().cast("array<bigint>"), step))
    return picks.select(*keys, F.when(F.size("_p") == want, F.col("_p")).alias("picks"))


def even_thinning(rows: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """Elements floor(i * n / keep) for i < keep; all where there are no more than `keep`."""
    w = Window.partitionBy(*keys)
    d = rows.withColumn("_i", F.row_number().over(_by(keys, *order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.ceil(F.col("_i") * keep / F.col("_n"))
    return d.where((F.col("_n") <= keep) | ((F.floor(step * F.col("_n") / keep) == F.col("_i")) & (step < keep))).drop("_i", "_n")


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Row number within each key along `order`, however many rows one key has.

    Rows are dealt by ranges of keys and order, sorted and written to the shared folder with their places; a key's
    numbers go on from the ranges before. The only table of its own has one row a key and range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = shared_checkpoint(rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    d = d.withColumn("_range", F.shiftright("_at", 33))
    c = d.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(_by(keys, "_range").rowsBetween(Window.unboundedPreceding, -1))
    c = c.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_range"]], (F.coalesce(earlier, F.lit(0)) + 1 - F.col("_first")).alias("_add"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_range"]]
    return d.join(c, same).select(*rows.columns, (F.col("_at") + F.col("_add")).alias(name))


def round_robin(rows: DataFrame, cls: str, order: list) -> DataFrame:
    """Rank within the class, which read across classes interleaves them."""
    return numbered(rows, [cls], order, "turn")


def scan_gate(scans: DataFrame, keys: list[str], time: str, tie: str, code: str, quiet: int) -> DataFrame:
    """Drop a scan when the row before it has the same code and is less than `quiet` old."""
    w = _by(keys, time, tie)
    again = (F.lag(code).over(w) == F.col(code)) & (F.col(time) - F.lag(time).over(w) < quiet)
    return scans.withColumn("_again", F.coalesce(again, F.lit(False))).where("not _again").drop("_again")


def arrival_lateness(msgs: DataFrame, keys: list[str], order: list[str], host: str, device: str, limit: float, drift: float = 1.001) -> DataFrame:
    """Reflected walk of host time against device time: running sum less the least of 0 and its running minimum."""
    w = _by(keys, *order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.coalesce((F.col(host) - F.lag(host).over(w)) - (F.col(device) - F.lag(device).over(w)) * drift, F.lit(0.0))
    d = msgs.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(run))
    d = d.withColumn("late_ms", F.round(F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(run)), 3))
    return d.withColumn("late", F.col("late_ms") > limit).drop("_step", "_sum")


def unwrap_clock(msgs: DataFrame, keys: list[str], order: list[str], clock: str, bits: int = 32) -> DataFrame:
    """Monotonic milliseconds from a counter of `bits` bits: modular steps add up; a step back counts 0."""
    w = _by(keys, *order)
    delta = F.pmod(F.col(clock) - F.lag(clock).over(w), F.lit(1 << bits))
    step = F.when(delta < (1 << (bits - 1)), delta).otherwise(F.lit(0))
    return msgs.withColumn("mono_ms", F.coalesce(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))


def sequence_quality(msgs: DataFrame, keys: list[str], order: list[str], seq: str) -> DataFrame:
    """Against the greatest sequence number so far in a boot: duplicate or old, or how many were missed before it."""
    w = _by(keys, *order)
    top = F.max(seq).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = msgs.withColumn("_top", top)
    return d.withColumn("status", F.when(F.col("_top").isNull(), "first").when(F.col(seq) <= F.col("_top"), "duplicate").when(F.col(seq) > F.col("_top") + 1, "gap").otherwise("ok")).withColumn("missing", F.when(F.col(seq) > F.col("_top") + 1, F.col(seq) - F.col("_top") - 1).otherwise(F.lit(0))).drop("_top")


def binned_max(rows: DataFrame, keys: list[str], time: str, value: str, bins: int) -> DataFrame:
    """Maximum per key in `bins` equal bins of the key's own time span; `sustained` is the least of a bin and the one before."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(time).over(w), F.max(time).over(w)
    slot = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col(time) - lo) * bins / (hi - lo)), F.lit(bins - 1)))
    d = rows.withColumn("bin", slot.cast("int")).groupBy(*keys, "bin").agg(F.max(value).alias("peak"))
    o = _by(keys, "bin")
    return d.withColumn("sustained", F.when(F.lag("bin").over(o) == F.col("bin") - 1, F.least("peak", F.lag("peak").over(o))))


def link_spans(links: DataFrame, keys: list[str], time: str, tie: str, partner: str, gap: int) -> DataFrame:
    """Extend the last span while the partner is the same and the gap small enough."""
    w = _by(keys, time, tie)
    new = (F.lag(partner).over(w) != F.col(partner)) | (F.col(time) - F.lag(time).over(w) > gap)
    return islands(links, keys, [time, tie], new).groupBy(*keys, "island", partner).agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count(F.lit(1)).alias("windows")).drop("island")


def recent_max(rows: DataFrame, keys: list[str], time: str, inside: Column, value: str, back: int) -> DataFrame:
    """Per key the greatest value in the last `back` before its last inside sample."""
    w = Window.partitionBy(*keys)
    d = rows.withColumn("_last", F.max(F.when(inside, F.col(time))).over(w))
    return d.where(F.col(time).between(F.col("_last") - back, F.col("_last"))).groupBy(*keys).agg(F.first("_last").alias("last_inside_ms"), F.max(value).alias("recent_max"))


def take_clusters(rows: DataFrame, keys: list[str], time: str, tie: str, gap: int) -> DataFrame:
    """Take number: a new take after a gap over `gap` or at an unknown time."""
    w = _by(keys, F.asc_nulls_last(time), tie)
    new = F.col(time).isNull() | (F.col(time) - F.lag(time).over(w) > gap)
    d = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(new.cast("int"), F.lit(0))))
    return d.withColumn("take_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def lag_search(a: DataFrame, b: DataFrame, keys: list[str], time: str, value: str, lags: list[int], slot: int) -> DataFrame:
    """For each lag: mean absolute difference of samples of a and of b shifted by it that share a time slot; best first.

    b is replicated by the fixed lag grid, not by its size; the join is an equi-join on keys, lag and slot.
    """
    spark_lags = F.explode(F.array(*[F.lit(x).cast("bigint") for x in lags]))
    left = a.withColumn("lag_ms", spark_lags).withColumn("_s", F.floor(F.col(time) / slot)).groupBy(*keys, "lag_ms", "_s").agg(F.avg(value).alias("_a"))
    right = b.withColumn("lag_ms", spark_lags).withColumn("_s", F.floor((F.col(time) + F.col("lag_ms")) / slot)).groupBy(*keys, "lag_ms", "_s").agg(F.avg(value).alias("_b"))
    cost = left.join(right, [*keys, "lag_ms", "_s"]).groupBy(*keys, "lag_ms").agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("cost"), F.count(F.lit(1)).alias("pairs"), F.corr("_a", "_b").alias("corr"))
    w = Window.partitionBy(*keys)
    return cost.withColumn("best", F.row_number().over(w.orderBy("cost", "lag_ms")) == 1).withColumn("before", F.lag("cost").over(w.orderBy("lag_ms"))).withColumn("after", F.lead("cost").over(w.orderBy("lag_ms")))


def parabolic_shift(before: Column, cost: Column, after: Column, step: int) -> Column:
    """Offset of a parabola's minimum through three costs one step apart; 0 where it has none."""
    curve = before - 2 * cost + after
    return F.when(curve > 0, 0.5 * (before - after) / curve * step).otherwise(F.lit(0.0))


def clip_windows(anchors: DataFrame, events: DataFrame, keys: list[str], length: int, cover: float = 0.5, cover_event: float = 0.8) -> DataFrame:
    """Label of each window [anchor - length, anchor]: the event that overlaps it most, where the overlap is at least
    `cover` of the window or `cover_event` of the event; otherwise background."""
    a = anchors.withColumn("w_start", F.col("anchor") - length)
    j = range_join(a, events, keys, "w_start", "anchor", "e_start", "e_end", length)
    shared = F.least("anchor", "e_end") - F.greatest("w_start", "e_start")
    j = j.withColumn("shared", shared).where((F.col("shared") >= cover * length) | (F.col("shared") >= cover_event * (F.col("e_end") - F.col("e_start"))))
    best = j.groupBy(*keys, "anchor").agg(F.max_by("label", F.struct(F.col("shared"), -F.col("e_start"), F.col("label"))).alias("label"))
    return anchors.join(best, [*keys, "anchor"], "left").withColumn("label", F.coalesce("label", F.lit("background")))
