"""Judging links, labels, boxes and devices against what is sure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouped import grouped
from .joins import as_of
from .sweeps import changes


def _several(candidates: DataFrame, keys: list[str], near: str, start: str, far: str, *more: Column, close_cm: float = 15.0, far_cm: float = 30.0) -> DataFrame:
    """(keys, near, start, _mark, _seen, more): windows of several candidates with samples. _mark: start and the one that can be
    meant, or null; _seen: all candidates; more: aggregates over these. Windows of one candidate end here, before any list is made.
    A candidate that may be close, as points or their distance are unknown, is not far away either."""
    on = [*keys, near, start]
    live = F.col("samples") > 0
    c = candidates.withColumn("_n", F.count_if(live).over(Window.partitionBy(*on))).where("_n >= 2")
    c = c.withColumn("_close", live & (F.col("points") >= 2) & (F.col("point_gap") <= close_cm))
    apart = F.count_if(live & ~F.col("_close") & (F.col("floor_gap") >= far_cm))
    mark = F.when((F.count_if("_close") == 1) & (apart == F.max("_n") - 1), F.struct(F.col(start).alias("at"), F.max(F.when(F.col("_close"), F.col(far))).alias("sure")))
    return c.groupBy(*on).agg(mark.alias("_mark"), F.collect_set(far).alias("_seen"), *more)


def _named(windows: DataFrame, keys: list[str], near: str, start: str) -> DataFrame:
    """Windows of `_several` that name somebody: sure by their own mark, carried by the nearest one (ties: the earlier) that is not of an unknown."""
    rising, falling = (Window.partitionBy(*keys, near).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(start), F.desc(start)))
    known = F.when(F.col("_mark.sure").isNotNull(), F.col("_mark"))
    n = windows.withColumn("_b", F.last(known, ignorenulls=True).over(rising)).withColumn("_a", F.last(known, ignorenulls=True).over(falling))
    pick = F.when(F.col("_a").isNull() | (F.col(start) - F.col("_b.at") <= F.col("_a.at") - F.col(start)), F.col("_b")).otherwise(F.col("_a"))
    n = n.withColumn("sure", F.coalesce("_mark", pick)["sure"])
    return n.withColumn("kind", F.when(F.col("_mark").isNotNull(), "sure").when(F.array_contains("_seen", F.col("sure")), "carried")).where("kind is not null").drop("_mark", "_seen", "_b", "_a")


def judged_windows(candidates: DataFrame, keys: list[str], near: str, start: str, far: str, *more: Column) -> DataFrame:
    """(keys, near, start, more, sure, kind): `sure_pairs` and `carried_pairs` of the candidates as kinds sure and carried, with
    more aggregates over each window's candidates; windows without a key or a start are left out.

    Candidates are read once, and not shuffled again where they come dealt by window; only windows of several candidates go on
    to the near person's order of time.
    """
    return _named(_several(candidates, keys, near, start, far, *more), keys, near, start).dropna(subset=[*keys, near, start])


def sure_pairs(candidates: DataFrame, keys: list[str], near: str, start: str, far: str, close_cm: float = 15.0, far_cm: float = 30.0) -> DataFrame:
    """(keys, near, start, sure): windows in which only one of several candidates can be meant.

    candidates: samples (all shared ones), points and point_gap (those with ankles in both views, and their distance),
    floor_gap (a lower bound of the distance). One candidate alone is within `close_cm` by two points at least, and every other
    one is `far_cm` away or more.
    """
    return _several(candidates, keys, near, start, far, close_cm=close_cm, far_cm=far_cm).where("_mark is not null").select(*keys, near, start, "_mark.sure")


def carried_pairs(candidates: DataFrame, sure: DataFrame, keys: list[str], near: str, start: str, far: str) -> DataFrame:
    """(keys, near, start, sure) of the other windows with several candidates: whom the nearest sure window of the near person
    names (ties: the earlier), if that person is a candidate now."""
    on = [*keys, near, start]
    marks = sure.select(*on, F.struct(F.col(start).alias("at"), "sure").alias("_mark"))
    both = _several(candidates, keys, near, start, far).drop("_mark").unionByName(marks, allowMissingColumns=True)
    both = both.groupBy(*on).agg(F.first("_mark", ignorenulls=True).alias("_mark"), F.first("_seen", ignorenulls=True).alias("_seen"))
    return _named(both, keys, near, start).where("kind = 'carried'").dropna(subset=on).select(*on, "sure")


def link_counts(judged: DataFrame, got: str, by: list[str]) -> DataFrame:
    """Windows whose link is right, another person's (wrong), or missing (none), by what is sure there."""
    g, s = F.col(got), F.col("sure")
    return judged.groupBy(*by).agg(F.count_if(g == s).alias("right"), F.count_if(g != s).alias("wrong"), F.count_if(g.isNull()).alias("none"))


def score_links(links: DataFrame, reference: DataFrame, keys: list[str], near: str, start: str, far: str, by: list[str]) -> DataFrame:
    """Windows of the reference whose link is right, another person's (wrong), or missing (none)."""
    return link_counts(reference.join(links.select(*keys, near, start, F.col(far).alias("_got")), [*keys, near, start]), "_got", by)


def label_outcomes(labels: DataFrame, episodes: DataFrame, keys: list[str], window: int) -> DataFrame:
    """What the episodes of a lane make of each label: FOUND, SWAP_BACK or MISSED, with episode, direction and cause.

    labels: keys, id, at, action (take or return); episodes: keys, id, start_ms, end_ms, state, changed, direction. A take and
    a later return inside one unchanged episode cannot be seen (each label is used once, in order of time). Other labels
    take the changed episode that holds them, else the nearest within `window`, else the earlier; a missed one names the
    state of the nearest episode, or NO_EPISODE.
    """
    lb = labels.select(*keys, F.lit(0).alias("kind"), "id", F.col("at").alias("s"), F.col("at").alias("e"), F.col("action").alias("state"), F.lit(False).alias("changed"), F.lit(None).cast("string").alias("direction"))
    ep = episodes.select(*keys, F.lit(1).alias("kind"), "id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "state", "changed", "direction")
    agrees = {("DECREASED", "take"), ("INCREASED", "return")}

    def run(pdf):
        rows = sorted(pdf[["kind", "s", "id", "e", "state", "changed", "direction"]].itertuples(index=False, name=None))
        mine, found = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        gap = lambda ep, t: max(ep[1] - t, t - ep[3], 0)
        around = {r[2]: [ep for ep in found if gap(ep, r[1]) <= window] for r in mine}
        still = {k: [ep[2] for ep in eps if ep[4] == "compared" and not ep[5]] for k, eps in around.items()}
        out = {}
        for a in mine:
            if a[4] != "take" or a[2] in out:
                continue
            for b in mine:
                shared = [k for k in still[a[2]] if k in still[b[2]]]
                if b[4] == "return" and b[1] >= a[1] and b[2] not in out and shared:
                    out[a[2]] = out[b[2]] = ("SWAP_BACK", shared[0], None, "unchanged behind one episode")
                    break
        for _, t, k, _, action, *_ in mine:
            if k in out:
                continue
            changed = [ep for ep in around[k] if ep[4] == "compared" and ep[5]]
            best = min(changed or around[k], key=lambda ep: (gap(ep, t), ep[1]), default=None)
            if changed:
                way = best[6] if best[6] in ("DECREASED", "INCREASED") else None
                out[k] = ("FOUND", best[2], "UNKNOWN" if way is None else "RIGHT" if (way, action) in agrees else "WRONG", None)
            else:
                out[k] = ("MISSED", best[2] if best else None, None, f"only {best[4]}" if best else "NO_EPISODE")
        return [(k, *v) for k, v in out.items()]

    return grouped(lb.unionByName(ep), keys, run, "label_id long, outcome string, episode_id long, direction string, cause string")


def device_events(messages: DataFrame, device: str, time: str, tie: str, boot: str, sequence: str, late: Column, stale: int, small_gap: int = 5) -> DataFrame:
    """(device, time, tie, kind, missing): first seen, restored after `stale` ms of silence, rebooted, over `small_gap` messages missing
    within a boot, and the start and end of lateness (which begins anew after a silence)."""
    w = Window.partitionBy(device).orderBy(time, tie)
    d = messages.withColumn("_prev", F.lag(time).over(w)).withColumn("_boot", F.lag(boot).over(w)).withColumn("_seq", F.lag(sequence).over(w)).withColumn("_late", late)
    first, restored = F.col("_prev").isNull(), F.col(time) - F.col("_prev") > stale
    d = d.withColumn("_was", F.coalesce(F.when(~F.coalesce(restored, F.lit(False)), F.lag("_late").over(w)), F.lit(False)))
    missing = F.col(sequence) - F.col("_seq") - 1
    same = F.col(boot).eqNullSafe(F.col("_boot"))
    kinds = [
        (first, "DEVICE_SEEN"), (restored, "DEVICE_RESTORED"), (~first & ~same, "DEVICE_REBOOT"), (~first & same & (missing > small_gap), "SEQUENCE_GAP"),
        (F.col("_late") & ~F.col("_was"), "BACKLOG_START"), (~F.col("_late") & F.col("_was"), "BACKLOG_END"),
    ]
    found = F.filter(F.array(*[F.struct(F.coalesce(c, F.lit(False)).alias("is"), F.lit(k).alias("kind")) for c, k in kinds]), lambda x: x["is"])
    return d.select(device, time, tie, missing.alias("_m"), F.explode(found).alias("_k")).select(device, time, tie, F.col("_k.kind").alias("kind"), F.when(F.col("_k.kind") == "SEQUENCE_GAP", F.col("_m")).alias("missing"))


def restocking(rows: DataFrame, switches: DataFrame, keys: list[str], time: str, tie: str, on: str, timeout: int) -> DataFrame:
    """rows with `restock`: whether the last switch at or before them (keys, time, tie, on) turned restocking on, `timeout` ms ago at most;
    a switch on while it is on does not prolong it."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    s = switches.withColumn("_was", F.lag(on).over(w)).withColumn("_since", F.when(F.col(on) & ~F.coalesce("_was", F.lit(False)), F.col(time)))
    s = s.withColumn("_since", F.last("_since", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.select(*keys, time, tie, F.struct(F.col(on).alias("on"), F.col("_since").alias("since")).alias("switch"))
    got = as_of(rows, s, keys, time, tie, "switch")
    flag = F.coalesce(F.col("last_switch.on") & (F.col(time) - F.col("last_switch.since") <= timeout), F.lit(False))
    return got.select(*keys, time, tie, flag.alias("restock"))


def same_place(boxes: DataFrame, keys: list[str], frame: str, ident: str, side: float, same: float) -> DataFrame:
    """(ident, _f): each box with the other frames that show one of IoU over `same` under its keys, repeated for each such box.

    Partitions are sorted by x1 and streamed; what is held is a batch and the rows before it in reach.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    b = boxes.select(*keys, frame, ident, *[F.col(c).cast("double").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")]).dropna()
    schema = T.StructType([b.schema[ident], T.StructField("_f", b.schema[frame].dataType)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = changes(held, batch, keys)
            n0 = 0 if held is None or new[0] else held.num_rows
            group = np.concatenate([np.zeros(n0, np.int64), np.cumsum(new) - new[0]])
            t = pa.Table.from_batches([held, batch] if n0 else [batch]).combine_chunks()
            ids, frames, x1, y1, x2, y2 = (t[c].combine_chunks() for c in (ident, frame, "_x1", "_y1", "_x2", "_y2"))
            of, x1, y1, x2, y2 = (c.to_numpy(zero_copy_only=False) for c in (frames, x1, y1, x2, y2))
            size, i, k, found, total = (x2 - x1) * (y2 - y1), np.arange(t.num_rows), 0, [], 0
            while len(i):
                k += 1
                i = i[: np.searchsorted(i, t.num_rows - k)]
                i = i[(group[i] == group[i + k]) & (x1[i + k] < x1[i] + side)]
                a = i[np.searchsorted(i, n0 - k) :]
                b = a + k
                shared = np.maximum(np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b]), 0) * np.maximum(np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]), 0)
                hit = (of[a] != of[b]) & (shared > same * (size[a] + size[b] - shared))
                found.append((a[hit], b[hit]))
                total += int(hit.sum())
                if total and (total >= 1 << 17 or not len(i)):
                    one, other = (np.concatenate(c) for c in zip(*found, strict=True))
                    found, total = [], 0
                    one, other = pa.array(np.concatenate([one, other])), pa.array(np.concatenate([other, one]))
                    yield pa.RecordBatch.from_arrays([ids.take(one), frames.take(other)], schema=arrow)
            last = np.flatnonzero((group == group[-1]) & (x1 + side > x1[-1]))
            held = t.slice(last[0] if len(last) else t.num_rows - 1).combine_chunks().to_batches()[0]

    return b.repartition(*keys).sortWithinPartitions(*keys, "_x1").mapInArrow(run, schema)


def box_stability(boxes: DataFrame, group: list[str], frame: str, ident: str, cls: str, side: float, same: float = 0.3, moved: float = 0.15) -> DataFrame:
    """For each box (ident) the share of the group's other frames with a box of its class of IoU over `same`, and whether it moved (under `moved`).

    side: no box is longer; boxes of a group and class are swept by x1, each with those that begin within this reach.
    """
    hits = same_place(boxes, [*group, cls], frame, ident, side, same).groupBy(ident).agg(F.count_distinct("_f").alias("_n"))
    others = boxes.groupBy(*group).agg((F.count_distinct(frame) - 1).alias("_others"))
    share = F.when(F.col("_others") > 0, F.coalesce("_n", F.lit(0)) / F.col("_others")).otherwise(F.lit(0.0))
    return boxes.select(*group, ident).join(hits, ident, "left").join(others, group).select(*group, ident, share.alias("stability"), (share < moved).alias("moved"))


