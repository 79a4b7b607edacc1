"""One-to-one matching. Candidates come from native joins; the decision runs per group on small pandas frames."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from statistics import fmean, median, mode

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouped import grouped, listed


def stretches(df: DataFrame, keys: list[str], start: str, end: str, slack: float, rows: int) -> DataFrame:
    """Adds _cut, which deals a key's rows, in order, to groups that end at pauses over `slack`.

    No rows of two groups can match. A group has about `rows` rows, or as many as come without a pause.
    """
    w = Window.partitionBy(*keys).orderBy(start)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.greatest(start, end)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_first", F.when(F.col(start) - reach > slack, F.row_number().over(w)))
    return d.withColumn("_cut", F.floor(F.coalesce(F.max("_first").over(so_far), F.lit(0)) / rows)).drop("_first")


def match_alerts(df: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Alerts against true events of one file and class, in time order.

    Rows: side (alert or event), id, start_ms, end_ms, decided in stretches that pauses part. The nearest
    unmatched event whose widened span holds the alert is a hit with a latency; if all such are taken the alert is a
    duplicate; if there is none it is false. Events left over are missed.
    """

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        ev = pdf[pdf.side == "event"].sort_values(["start_ms", "id"])
        al = pdf[pdf.side == "alert"].sort_values(["start_ms", "id"])
        eid, es, ee = ev.id.tolist(), ev.start_ms.tolist(), ev.end_ms.tolist()
        reach = np.maximum.accumulate(ev.end_ms.to_numpy(np.int64)) if len(ev) else np.zeros(0, np.int64)  # rises, so both ends are found by bisection
        used, rows = [False] * len(ev), []
        for i, t in zip(al.id, al.start_ms, strict=True):
            lo, hi = int(np.searchsorted(reach, t - tolerance)), bisect_right(es, t + tolerance)
            near = [k for k in range(lo, hi) if t <= ee[k] + tolerance]
            free = [k for k in near if not used[k]]
            if free:
                k = min(free, key=lambda k: (abs(es[k] - t), k))
                used[k] = True
                rows.append((i, "hit", eid[k], t - es[k]))
            else:
                rows.append((i, "duplicate" if near else "false", None, None))
        rows += [(None, "missed", e, None) for e, u in zip(eid, used, strict=True) if not u]
        return rows

    cut = stretches(df, keys, "start_ms", "end_ms", tolerance, 1000)
    return grouped(cut, [*keys, "_cut"], fn, "alert_id long, outcome string, event_id long, latency_ms long").drop("_cut")


def match_candidates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate intervals against labelled ones by overlap, in order of start.

    Rows: side (candidate or label), kind (TAKE or BROWSE for labels), id, start_ms, end_ms, decided in stretches
    that pauses part. The first unmatched overlapping TAKE is a hit; otherwise an overlapping BROWSE or nothing says what
    kind of false alarm it is.
    """

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        la, ca = (pdf[pdf.side == s].sort_values(["start_ms", "id"]) for s in ("label", "candidate"))
        ids, take, ls, le = la.id.tolist(), (la.kind == "TAKE").tolist(), la.start_ms.tolist(), la.end_ms.tolist()
        reach = np.maximum.accumulate(la.end_ms.to_numpy(np.int64)) if len(la) else np.zeros(0, np.int64)
        used, rows = set(), []
        for i, s, e in zip(ca.id.tolist(), ca.start_ms.tolist(), ca.end_ms.tolist(), strict=True):
            over = [k for k in range(int(np.searchsorted(reach, s)), bisect_right(ls, e)) if le[k] >= s]
            free = next((k for k in over if take[k] and k not in used), None)
            if free is not None:
                used.add(free)
                rows.append((i, "tp", ids[free]))
            else:
                rows.append((i, "fp_other" if all(take[k] for k in over) else "fp_browse", None))
        rows += [(None, "fn", i) for k, i in enumerate(ids) if take[k] and k not in used]
        return rows

    cut = stretches(df, keys, "start_ms", "end_ms", 0, 1000)
    return grouped(cut, [*keys, "_cut"], fn, "candidate_id long, outcome string, label_id long").drop("_cut")


def best_pairs(a: np.ndarray, b: np.ndarray, before: float, after: float) -> list[tuple[int, int]]:
    """Most pairs of two sorted time lists with b - a in [-before, after]; among those the least total |b - a|.

    An order-preserving optimum exists for equal windows, so a table over prefixes finds it. Row i holds (pairs, -cost) of
    the first i of a with the first j of b, for j from just before the window of a[i - 1] to its end: past the end nothing
    changes, and before the start it is row i - 1. A row is made by whole-array steps; of past rows only two bits a place
    are kept, whether it equals the place above and the one to the left.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    times, row, high = b.tolist(), np.zeros(1, complex), 0  # pairs + i * -cost: complex numbers compare by parts, in this order
    low, width, ups, lefts = [0], [1], [b""], [b""]
    for x in a.tolist():
        first, last = bisect_left(times, -before, key=lambda v: v - x), bisect_right(times, after, key=lambda v: v - x)
        kept = row[min(first, high) - low[-1] :][: last - first + 1]
        if len(kept) <= last - first:
            kept = np.concatenate([kept, np.full(last - first + 1 - len(kept), row[-1])])
        new = kept.copy()
        paired = kept[:-1] + 1
        paired.imag -= np.abs(b[first:last] - x)
        np.maximum(new[1:], paired, out=new[1:])
        np.maximum.accumulate(new, out=new)
        ups.append(np.packbits(new == kept).tobytes())
        lefts.append(np.packbits(new[1:] == new[:-1]).tobytes())
        low.append(first)
        width.append(len(new))
        row, high = new, last
    bit = lambda bits, k: bits[k >> 3] >> (7 - (k & 7)) & 1
    out, i, j = [], len(a), len(b)
    while i and j:
        j = min(j, low[i] + width[i] - 1)
        if j <= low[i] or bit(ups[i], j - low[i]):
            i -= 1
        elif bit(lefts[i], j - low[i] - 1):
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


def match_labels(df: DataFrame, keys: list[str], before: float, after: float, keep_time: bool = False) -> DataFrame:
    """Labels with sensor events of one lane and direction by best_pairs. Rows: side (label or sensor), id, at. keep_time: adds
    the time of the label, or of the sensor without one, as `at`.

    No pair reaches across a pause longer than both windows, so groups end at such pauses.
    """

    numbered = "unit" in df.columns
    by = ["id", "unit"] if numbered else ["id"]
    none = (None,) * len(by)

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        a, b = (pdf[pdf.side == s].sort_values(["at", *by]) for s in ("label", "sensor"))
        at, bt = a["at"].to_numpy(float), b["at"].to_numpy(float)
        pairs = best_pairs(at, bt, before, after)
        la, sb = {i for i, _ in pairs}, {j for _, j in pairs}
        a, b = (list(x[by].itertuples(index=False, name=None)) for x in (a, b))
        rows = [("matched", *a[i], *b[j], bt[j] - at[i], at[i]) for i, j in pairs]
        rows += [("missed", *x, *none, None, at[i]) for i, x in enumerate(a) if i not in la]
        rows += [("ghost", *none, *x, None, bt[j]) for j, x in enumerate(b) if j not in sb]
        return rows

    cut = stretches(df, keys, "at", "at", max(before, after), 1000)
    ids = ", ".join(f"{side}_{c} long" for side in ("label", "sensor") for c in by)
    return grouped(cut, [*keys, "_cut"], fn, f"kind string, {ids}, dt double, at double").drop("_cut", *([] if keep_time else ["at"]))


def hungarian(score: np.ndarray) -> list[tuple[int, int]]:
    """Assignment with the greatest total score (potentials and augmenting paths); rows may outnumber columns."""
    if not score.size:
        return []
    flip = score.shape[0] > score.shape[1]
    c = -(score.T if flip else score)
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j0]:
            seen[j0] = True
            i0 = owner[j0]
            cur = c[i0 - 1] - u[i0] - v[1:]
            better = ~seen[1:] & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            free = np.where(seen[1:], np.inf, low[1:])
            j1 = int(free.argmin()) + 1
            d = free[j1 - 1]
            u[owner[seen]] += d
            v[seen] -= d
            low[~seen] -= d
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def assign(scores: DataFrame, keys: list[str], left: str, right: str, score: str, least: float) -> DataFrame:
    """Best one-to-one assignment in each group (a time window of a store), dropping pairs under `least`."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        a, b = np.sort(pdf[left].unique()), np.sort(pdf[right].unique())
        s = np.full((len(a), len(b)), -1.0)
        s[np.searchsorted(a, pdf[left]), np.searchsorted(b, pdf[right])] = pdf[score]
        rows = [(a[i], b[j], s[i, j]) for i, j in hungarian(s) if s[i, j] >= least]
        return rows

    kinds = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in (left, right, score))
    return grouped(scores.select(*keys, left, right, score), keys, fn, kinds)


def greedy_map(scores: DataFrame, keys: list[str], left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one by falling score; ties by left, then right. A group is one run, with as many ids as a recording has."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        used_a, used_b, rows = set(), set(), []
        for a, b, s in pdf[pdf[score] >= least].sort_values([score, left, right], ascending=[False, True, True])[[left, right, score]].itertuples(index=False):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                rows.append((a, b, s))
        return rows

    kinds = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in (left, right, score))
    return grouped(scores.select(*keys, left, right, score), keys, fn, kinds)


def reading_order(boxes: DataFrame, keys: list[str], ident: str, x: str, y: str, height: str, gap: float = 0.5) -> DataFrame:
    """Rows from top to bottom by the running mean of a row's centre, places by x."""

    def fn(pdf: dict[str, list]) -> list[tuple]:
        rows: list[list[tuple]] = []
        for v, u, i, h in sorted(zip(pdf[y], pdf[x], pdf[ident], pdf[height], strict=True)):
            if rows and abs(v - fmean(r[1] for r in rows[-1])) <= gap * h:
                rows[-1].append((u, v, i))
            else:
                rows.append([(u, v, i)])
        return [(b[2], r, k) for r, row in enumerate(rows) for k, b in enumerate(sorted(row, key=lambda b: (b[0], b[2])))]

    return listed(boxes.select(*keys, ident, x, y, height), keys, fn, f"{ident} {boxes.schema[ident].dataType.simpleString()}, row_no int, place int")


def consensus(frames: DataFrame, keys: list[str], box: tuple[str, str], label: str, score: str, frame: str, presence: float, near: float) -> DataFrame:
    """Objects seen near one place in at least `presence` of a group's frames: median place, modal label, mean score."""
    x, y = box

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        total, clusters = pdf[frame].nunique(), []  # a cluster: members, middle x, middle y
        for b in sorted(zip(pdf[frame], pdf[x], pdf[y], pdf[label], pdf[score], strict=True)):
            best = min(clusters, key=lambda c: (c[1] - b[1]) ** 2 + (c[2] - b[2]) ** 2, default=None)
            if best is None or (best[1] - b[1]) ** 2 + (best[2] - b[2]) ** 2 > near**2:
                best = [[], 0.0, 0.0]
                clusters.append(best)
            best[0].append(b)
            best[1], best[2] = median(r[1] for r in best[0]), median(r[2] for r in best[0])
        shares = [(c, len({r[0] for r in c[0]}) / total) for c in clusters]
        return [(c[1], c[2], mode(r[3] for r in c[0]), fmean(r[4] for r in c[0]), share) for c, share in shares if share >= presence]

    return grouped(frames.select(*keys, frame, x, y, label, score), keys, fn, "x double, y double, label string, score double, presence double")


def staged_compare(labels: DataFrame, sensors: DataFrame, pair: str, lane: str, direction: str, before: float, after: float) -> DataFrame:
    """Labels and sensor events unit by unit: first within a lane, then across lanes, then missed and ghosts.

    Rows: pair, lane, direction, id, at, qty. A quantity of n is n units, told apart by label_unit and sensor_unit (from 0).
    """
    from ..sources.tables import shared_checkpoint

    of = [pair, lane, direction]
    units = lambda df, side: df.select(*of, F.lit(side).alias("side"), "at", "id", F.explode(F.sequence(F.lit(0).cast("long"), (F.greatest("qty", F.lit(1)) - 1).cast("long"))).alias("unit"))
    first = shared_checkpoint(match_labels(units(labels, "label").unionByName(units(sensors, "sensor")), of, before, after, keep_time=True))  # decided once, read for both stages
    rest = first.where("kind <> 'matched'").select(pair, direction, F.when(F.col("kind") == "missed", "label").otherwise("sensor").alias("side"), *[F.coalesce(f"label_{c}", f"sensor_{c}").alias(c) for c in ("id", "unit")], "at")
    second = match_labels(rest, [pair, direction], before, after)
    again = second.withColumn("kind", F.when(F.col("kind") == "matched", "other_lane").otherwise(F.col("kind")))
    out = [pair, direction, "kind", "label_id", "label_unit", "sensor_id", "sensor_unit", "dt"]
    return first.where("kind = 'matched'").select(out).unionByName(again.select(out))
