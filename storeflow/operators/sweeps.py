"""What lies in reach of each row, found by sweeps over sorted times instead of a join of all pairs in reach.

Both sides are dealt to time buckets of each key; a left row is in one bucket, a right row in every bucket whose left rows it
can serve. Only input rows are shuffled, and a task holds one bucket of one key at a time.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids in one batch of lists.
LISTED = 1 << 18


def swept(left: DataFrame, right: DataFrame, keys: list[str], at: Column, first: Column, last: Column, width: int, fn: Callable, schema: T.StructType) -> DataFrame:
    """fn(left, right) -> arrays of `schema`, batch by batch, for the Arrow tables of each key and bucket of `width`.

    A left row meets the right rows with first <= at <= last, and others of its bucket; fn sorts these out. Rows without a key
    or a time meet nothing, but left ones still reach fn. Columns of the sides differ in name, but for the keys.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    fl = lambda c: F.floor(c / width)
    l = left.withColumn("_b", fl(at)).withColumn("_left", F.lit(True))  # noqa: E741
    r = right.dropna(subset=keys).where(first.isNotNull() & last.isNotNull() & (first <= last)).withColumn("_b", F.explode(F.sequence(fl(first), fl(last)))).withColumn("_left", F.lit(False))
    groups, l_cols, r_cols = [*keys, "_b"], [*keys, *[c for c in left.columns if c not in keys]], [c for c in right.columns if c not in keys]

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            edges = np.flatnonzero(changes(held[-1] if held else None, batch, groups)).tolist()
            begin = 0
            for i in edges:
                held += [batch.slice(begin, i - begin)] if i > begin else []
                if held:
                    yield from close(held)
                held, begin = [], i
            held.append(batch.slice(begin))
        if held:
            yield from close(held)

    def close(held):
        t = pa.Table.from_batches(held).combine_chunks()
        one, other = t.filter(t["_left"]).select(l_cols), t.filter(pc.invert(t["_left"])).select(r_cols)
        if one.num_rows:
            for columns in fn(one, other):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else _whole(c).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    u = l.unionByName(r, allowMissingColumns=True)
    return u.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema)


def _whole(c):
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def changes(before: pa.RecordBatch | None, batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Which rows begin a group."""
    new = np.zeros(batch.num_rows, bool)
    for n in names:
        c = batch.column(n)
        differs = lambda a, b: pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        new[1:] |= differs(c.slice(1), c.slice(0, len(c) - 1))
        if before is not None:
            new[0] |= differs(before.column(n).slice(before.num_rows - 1), c.slice(0, 1))[0]
    return new


def _np(t: pa.Table, name: str) -> np.ndarray:
    return _whole(t[name]).to_numpy(zero_copy_only=False)


def present(moments: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, who: str, reach: int) -> DataFrame:
    """Each moment's columns and `people`: the sorted distinct `who` of points in its closed interval, which is at most `reach` long."""

    def fn(m: pa.Table, p: pa.Table):
        t, w = _np(p, at), _np(p, who)
        order = np.argsort(t, kind="stable")
        t, w = t[order], w[order]
        lo, hi = np.searchsorted(t, _np(m, start), "left"), np.searchsorted(t, _np(m, end), "right")
        found, begin, total = [], 0, 0
        for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            found.append(np.unique(w[a:b]))
            total += len(found[-1])
            if total >= LISTED or i == m.num_rows - 1:
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate(found).astype(np.int64))
                yield [*m.slice(begin, i + 1 - begin).columns, lists]
                found, begin, total = [], i + 1, 0

    schema = T.StructType([*(moments.schema[c] for c in [*keys, *[c for c in moments.columns if c not in keys]]), T.StructField("people", T.ArrayType(T.LongType()))])
    p = points.select(*keys, at, who).dropna(subset=[at, who])
    return swept(moments, p, keys, F.col(start), F.col(at) - reach, F.col(at), 2 * reach, fn, schema)


def nearest_holding(labels: DataFrame, boxes: DataFrame, keys: list[str], ident: str, time: str, level: str, at: str, value: str, box: str, owner: str, reach: int) -> DataFrame:
    """(ident, owner): each label's nearest box in time, at most `reach` away, whose value is at least the label's; of equals the smaller value, then the smaller id.

    Going one way through the boxes in time, a stack keeps those that no later one exceeds: values fall along it, so that a
    label finds the last one that holds it by bisection.
    """

    def fn(la: pa.Table, b: pa.Table):
        both = np.concatenate([_np(la, level), _np(b, value)])
        order = np.unique(both, return_inverse=True)[1]  # NaN is the largest
        want, has = order[: la.num_rows].tolist(), order[la.num_rows :].tolist()
        t, bt, ids = _np(la, time).tolist(), _np(b, at).tolist(), _np(b, box).tolist()
        best = [None] * len(t)
        for way in (1, -1):
            rows = sorted(range(len(bt)), key=lambda i: (way * bt[i], -has[i], -ids[i]))
            stack, falling, k = [], [], 0  # falling: values with the sign turned, to bisect
            for i in sorted(range(len(t)), key=lambda i: way * t[i]):
                while k < len(rows) and way * bt[rows[k]] <= way * t[i]:
                    j, k = rows[k], k + 1
                    while stack and has[stack[-1]] <= has[j]:
                        stack.pop()
                        falling.pop()
                    stack.append(j)
                    falling.append(-has[j])
                p = bisect_left(falling, 1 - want[i]) - 1
                if p >= 0:
                    j = stack[p]
                    rank = (abs(bt[j] - t[i]), has[j], ids[j])
                    if rank[0] <= reach and (best[i] is None or rank < best[i][0]):
                        best[i] = (rank, j)
        who = _np(b, owner).tolist()
        yield [la[ident], [None if x is None else who[x[1]] for x in best]]

    la, b = labels.select(*keys, ident, time, level), boxes.select(*keys, at, value, box, owner)
    schema = T.StructType([la.schema[ident], b.schema[owner]])
    t, v = F.col(time), F.col(at)
    none = labels.where(t.isNull() | F.col(level).isNull()).select(ident, F.lit(None).cast(schema[owner].dataType).alias(owner))
    found = swept(la.dropna(subset=[time, level]), b.dropna(subset=[at, value, box]), keys, t, v - reach, v + reach, 4 * reach, fn, schema)
    return found.unionByName(none)


def nearest_episode(labels: DataFrame, episodes: DataFrame, keys: list[str], label: str, time: str, episode: str, start: str, end: str, result: str, reach: int) -> DataFrame:
    """(keys, label, time, other columns of labels, episode, result): the earliest episode that holds each label, else the nearest within `reach`; of equals the earlier, then the smaller id.

    Open episodes wait in a heap by their start; closed ones leave the last end behind.
    """
    columns = [*keys, *[c for c in labels.columns if c not in keys]]

    def fn(la: pa.Table, b: pa.Table):
        times, s, e, ids = _np(la, time).tolist(), _np(b, start).tolist(), _np(b, end).tolist(), _np(b, episode).tolist()
        rows = sorted(range(len(s)), key=lambda i: (s[i], ids[i]))
        begun, ending, k, gone, found = [], [], 0, None, [None] * len(times)
        known = [i for i, t in enumerate(times) if t == t]
        for i in sorted(known, key=times.__getitem__):
            t = times[i]
            while k < len(rows) and s[rows[k]] <= t:
                j, k = rows[k], k + 1
                heapq.heappush(begun, (s[j], ids[j], j))
                heapq.heappush(ending, (e[j], s[j], ids[j], j))
            while ending and ending[0][0] < t:
                x = heapq.heappop(ending)
                if gone is None or x[0] > gone[0]:
                    gone = x
            while begun and e[begun[0][2]] < t:
                heapq.heappop(begun)
            if begun:
                found[i] = begun[0][2]
                continue
            before = None if gone is None else t - gone[0]
            after = s[rows[k]] - t if k < len(rows) else None
            if before is not None and before <= reach and (after is None or before <= after):
                found[i] = gone[3]
            elif after is not None and after <= reach:
                found[i] = rows[k]
        at = pa.array(found, pa.int64())
        yield [*(la[c] for c in columns), _whole(b[episode]).take(at), _whole(b[result]).take(at)]

    la, b = labels.select(*columns), episodes.select(*keys, start, end, episode, result)
    schema = T.StructType([*(la.schema[c] for c in columns), b.schema[episode], b.schema[result]])
    return swept(la, b.where(F.col(start) <= F.col(end)), keys, F.col(time), F.col(start) - reach, F.col(end) + reach, 4 * max(reach, 1), fn, schema)


def latest_visitor(payments: DataFrame, visits: DataFrame, keys: list[str], pay: str, time: str, visitor: str, start: str, reach: int) -> DataFrame:
    """(pay, payer, candidates): the visit that began last, at most `reach` before each payment (of equals the smaller visitor), and how many did."""

    def fn(p: pa.Table, v: pa.Table):
        t, s, who = _np(p, time), _np(v, start), _np(v, visitor)
        order = np.lexsort((-who, s))
        s, who = s[order], who[order]
        hi = np.searchsorted(s, t, "right")
        n = hi - np.searchsorted(s, t - reach, "left")
        at = pa.array(np.maximum(hi - 1, 0), pa.int64(), mask=n <= 0)
        yield [p[pay], pa.array(who, pa.int64()).take(at), n.astype(np.int64)]

    p, v = payments.select(*keys, pay, time), visits.select(*keys, start, visitor).dropna(subset=[start])
    schema = T.StructType([p.schema[pay], T.StructField("payer", v.schema[visitor].dataType), T.StructField("candidates", T.LongType())])
    return swept(p, v, keys, F.col(time), F.col(start), F.col(start) + reach, 2 * reach, fn, schema)


def first_near(moments: DataFrame, points: DataFrame, keys: list[str], own: str, start: str, level: str, at: str, value: str, who: str, reach: int, near: float) -> DataFrame:
    """Moments with `who` of the first point in [start, start + reach] (of equals the smaller who) that is not their own and whose value is
    under `near` from their level; others are left out.

    Points are dealt to bands of values, a little wider than `near`; a moment goes on in its own band and the two beside it until one fits.
    """
    columns = [*keys, *[c for c in moments.columns if c not in keys]]

    def fn(m: pa.Table, p: pa.Table):
        s, was, me = _np(m, start), _np(m, level), _np(m, own)
        t, v, w = _np(p, at), _np(p, value), _np(p, who)
        band, mine = np.floor(v / (1.05 * near)), np.floor(was / (1.05 * near))
        order = np.lexsort((w, t, band))
        t, v, w, band = t[order], v[order], w[order], band[order]
        best = np.full(len(s), -1)
        for b in np.unique(band).tolist():
            some = np.flatnonzero(np.abs(mine - b) <= 1)
            if not len(some):
                continue
            x, y = np.searchsorted(band, b, "left"), np.searchsorted(band, b, "right")
            i, end = x + np.searchsorted(t[x:y], s[some], "left"), x + np.searchsorted(t[x:y], s[some] + reach, "right")
            while len(some):
                left = i < end
                some, i, end = some[left], i[left], end[left]
                fits = (np.abs(v[i] - was[some]) < near) & (w[i] != me[some])
                k, j = some[fits], i[fits]
                o = best[k]
                first = (o < 0) | (t[j] < t[o]) | ((t[j] == t[o]) & (w[j] < w[o]))
                best[k[first]] = j[first]
                some, i, end = some[~fits], i[~fits] + 1, end[~fits]
        found = best >= 0
        yield [*(m.filter(pa.array(found))[c] for c in columns), w[best[found]]]

    m = moments.select(*columns).dropna(subset=[own, start, level])
    p = points.select(*keys, at, value, who).dropna(subset=[at, value, who])
    schema = T.StructType([*(m.schema[c] for c in columns), p.schema[who]])
    return swept(m, p, keys, F.col(start), F.col(at) - reach, F.col(at), 2 * reach, fn, schema)
