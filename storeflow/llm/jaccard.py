"""Exact Jaccard self-join over word-shingle sets, by set-relation skipping.

The join finds every pair of sets with 100 * |A & B| >= percent * |A | B| and reports connected components.

1. Documents become sets of 64-bit shingle hashes; equal sets share a set id, so copies cost one set.
2. Index. Shingles are dealt by hash range; each range learns in how many sets each shingle occurs and sends back only
   those that two or more sets hold. A shingle of one set cannot link anything; it merely uses up prefix places.
   Very frequent shingles are found beforehand by counts that add up in each task (a summary of bounded size, which
   finds every shingle above a share of all entries, however its sets are spread); they are known to be shared, so
   their sets go straight back, one row a set, and never meet in a range. Which way a shingle takes changes no result.
3. Prefixes. With shingles ordered by (frequency, hash), two linked sets meet within their first
   n - ceil(t n) + 1 places. Unshared shingles come first, so most sets have no place left and drop out here.
4. Skipping in the index. A list holds (set, size, place), sorted by size in blocks; a block is skipped when its largest
   possible overlap, from sizes, places and unshared counts, is too small for the probing set.
5. Skipping by answers. Each list first links every set to one highly connected set of it (the one with the fewest
   shingles of its own). Sets so joined need no further comparison, so what remains are pairs across components:
   a component's answers are derived through its hub instead of from all pairs. So not every link is written down,
   only enough of them that components are those of all links; numbers of links per document are not made.
6. Links are verified on all shared shingles; components come from rounds that hook roots, with pointer jumping.

No step sends sets, links or components to the driver, and no list is capped. Shingles are compared by 64-bit hashes.

Defined results: null texts and texts without words have 0 shingles and are linked with nothing (their component is
their own id); with fewer than k words the whole sequence is the one shingle; rows that repeat a doc_id are rows of
their own; a null doc_id keeps its row and never names a component unless its group has no other id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACED, U64, buffers, cut, map_text, mix, slices, small_batches, starts_of, word_table

BLOCK = 64
#: Bytes of text whose sets are made together.
SLICE = 4 << 20
#: Share of all (shingle, set) entries from which a shingle counts as very frequent.
SHARE = 1e-5
#: Shingles that a task's summary keeps.
SUMMARY = 400_000
_K = U64(0x9E3779B97F4A7C15)


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, document) of every distinct shingle, sorted by document and hash."""
    n = len(col)
    h, doc = word_table(*buffers(col), SPACED)
    first = starts_of(doc, n)
    count = np.diff(first)
    out_h, out_d = [], []
    if len(h) >= k:
        with np.errstate(over="ignore"):
            s = np.full(len(h) - k + 1, k, U64)
            for j in range(k):
                s = mix(s * _K + h[j : len(h) - k + 1 + j])
        same = doc[: len(h) - k + 1] == doc[k - 1 :]
        out_h.append(s[same])
        out_d.append(doc[: len(h) - k + 1][same])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        with np.errstate(over="ignore"):
            s = count[short].astype(U64)
            for j in range(k - 1):
                on = count[short] > j
                s[on] = mix(s[on] * _K + h[first[:-1][short][on] + j])
        out_h.append(s)
        out_d.append(short)
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    x, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return x[new], d[new]


def set_ids(x: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, set id) of each of n documents; the id is a hash of the whole set, 0 for an empty one."""
    size = np.bincount(d, minlength=n)
    with np.errstate(over="ignore"):
        c = np.concatenate([np.zeros(1, U64), np.cumsum(mix(x ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
        bound = np.concatenate([[0], np.cumsum(size)])
        ids = mix(c[bound[1:]] - c[bound[:-1]] + size.astype(U64) * _K)
    ids[size == 0] = 0
    return size, ids.view(np.int64)


def documents_to_sets(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc, n, set_id for each row."""

    def make(col):
        x, d = shingle_sets(col, k)
        size, ids = set_ids(x, d, len(col))
        return size, ids

    return map_text(docs, text, {"doc": doc_id}, [("n", "bigint"), ("set_id", "bigint")], make)


def _slice_sets(batches, k: int):
    """(shingle, document, set ids, sizes) of each slice of texts; a slice holds a set once."""
    for batch in batches:
        for i, j in slices(batch.column(0), SLICE):
            part = batch.column(0).slice(i, j - i)
            x, d = shingle_sets(part, k)
            size, ids = set_ids(x, d, len(part))
            _, one = np.unique(ids, return_index=True)
            chosen = np.zeros(len(part), bool)
            chosen[one] = True
            on = chosen[d]
            yield x[on], d[on], ids, size


def summed(h: np.ndarray, c: np.ndarray, h2: np.ndarray, c2: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted count tables as one of at most `keep` entries, by Misra and Gries: what is taken off a count is at
    most the sum of all counts over `keep`."""
    h = np.concatenate([h, h2])
    order = np.argsort(h, kind="stable")
    h, c = h[order], np.concatenate([c, c2])[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    h, c = h[at], np.add.reduceat(c, at) if len(at) else c[:0]
    if len(h) > keep:
        c = c - np.partition(c, len(c) - keep - 1)[len(c) - keep - 1]
        h, c = h[c > 0], c[c > 0]
    return h, c


def frequent_shingles(docs: DataFrame, text: str, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count), sorted: every shingle in at least SHARE of all (shingle, set of a slice) entries, if in `least` at least.

    A task reports what it counts in half that share of its entries (twice at least). With that and what a summary takes off, a quarter
    of a shingle's count remains at least, so a quarter is asked for, and at most 4 / SHARE shingles come back.
    """
    picked = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")

    def run(batches):
        h, c, total = np.zeros(0, U64), np.zeros(0, np.int64), 0
        for x, _, _, _ in _slice_sets(batches, k):
            h, c = summed(h, c, *np.unique(x, return_counts=True), SUMMARY)
            total += len(x)
        on = c >= max(2, SHARE * total / 2)
        yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(c[on].astype(np.int64)), pa.array(np.full(on.sum(), 0, np.int64))], names=["h", "c", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["h", "c", "total"])

    counted = picked.mapInArrow(run, "h long, c long, total long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))
    counted = cut(counted)
    total = counted.agg(F.sum("total")).first()[0] or 0
    got = counted.where(4 * F.col("c") >= max(least, SHARE * total)).toPandas()  # at most 4 / SHARE rows
    h, c = got["h"].to_numpy(np.int64).view(U64), got["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def frequent_entries(docs: DataFrame, text: str, k: int, frequent, homes: int) -> DataFrame:
    """What shared_shingles makes, for the frequent shingles: their sets need not meet to be known as shared.

    A row holds all of a set's frequent shingles; a set that many slices hold is made one row by shuffling on its id,
    after one of each task's is chosen.
    """
    picked = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")

    def rows(batches):
        known, _ = frequent.value
        for x, d, ids, size in _slice_sets(batches, k):
            on = _among(x, known)
            if not on.any():
                continue
            x, d = x[on], d[on]
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            end = np.append(at[1:], len(d))
            who = d[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(size[who].astype(np.int64)), pa.array([x[a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary())], names=["s", "n", "x"])

    def blobs(batches):
        known, counts = frequent.value
        for b in (b.slice(i, j - i) for b in batches for i, j in slices(b.column(2), SLICE)):
            s, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = [np.frombuffer(v.as_buffer(), U64) for v in b.column(2)]
            size = np.array([len(v) for v in x])
            x = np.concatenate(x)
            made = _by_home(x, np.repeat(s, size), np.repeat(n, size), counts[np.searchsorted(known, x)], homes)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["q", "who", "x", "df"])

    once = picked.mapInArrow(rows, "s long, n long, x binary").groupBy("s").agg(F.first("n").alias("n"), F.first("x").alias("x"))
    return once.mapInArrow(blobs, "q long, who binary, x binary, df binary")


def index_entries(docs: DataFrame, text: str, k: int, ranges: int, frequent=None) -> DataFrame:
    """Blobs of (shingle, set) by hash range, without frequent shingles."""
    picked = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")

    def run(batches):
        for x, d, ids, size in _slice_sets(batches, k):
            if frequent is not None:
                on = ~_among(x, frequent.value[0])
                x, d = x[on], d[on]
            p = _range(x, ranges)
            order = np.lexsort((x, p))
            x, d, p = x[order], d[order].astype(np.uint16), p[order]
            bound = np.searchsorted(p, np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(bound))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([_planes(x[bound[r] : bound[r + 1]]) for r in some], pa.binary()),
                    pa.array([d[bound[r] : bound[r + 1]].tobytes() for r in some], pa.binary()),
                    pa.array([_used(d[bound[r] : bound[r + 1]], ids, size) for r in some], pa.binary()),
                ],
                names=["r", "x", "d", "s"],
            )

    return picked.mapInArrow(run, "r long, x binary, d binary, s binary")


def _range(x: np.ndarray, ranges: int) -> np.ndarray:
    return ((x >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, which block compression shortens."""
    gap = np.diff(x, prepend=U64(0))
    return np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    m = len(b) // 8
    gap = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, m).T).view(U64).ravel()
    return np.cumsum(gap, dtype=U64)


def _used(d: np.ndarray, ids: np.ndarray, size: np.ndarray) -> bytes:
    """(set id, size) of the documents named in d, in their order."""
    u = np.unique(d)
    return ids[u].tobytes() + size[u].astype(np.int32).tobytes()


def _by_home(x: np.ndarray, s: np.ndarray, n: np.ndarray, df: np.ndarray, homes: int) -> list[tuple]:
    """(home, sets with their sizes and runs, shingles, frequencies) for each home."""
    home = (mix(s.view(U64)) % U64(homes)).astype(np.int64)
    order = np.lexsort((s, home))
    x, s, n, df, home = x[order], s[order], n[order], df[order], home[order]
    bound = np.searchsorted(home, np.arange(homes + 1))
    rows = []
    for q in np.flatnonzero(np.diff(bound)):
        a, b = bound[q], bound[q + 1]
        who, start = np.unique(s[a:b], return_index=True)
        runs = np.diff(np.append(start, b - a))
        rows.append((int(q), np.concatenate([who, n[a:b][start], runs]).tobytes(), x[a:b].tobytes(), df[a:b].astype(np.int64).tobytes()))
    return rows


def shared_shingles(entries: DataFrame, ranges: int, homes: int) -> DataFrame:
    """Per home (sets dealt by id) and range: shingles that two or more sets hold, with set, size and frequency."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ss, ns = [], [], []
        for x, d, s in zip(pdf["x"], pdf["d"], pdf["s"], strict=True):
            place, m = np.frombuffer(d, np.uint16), len(s) // 12
            at = np.searchsorted(np.unique(place), place)
            xs.append(_unplanes(x))
            ss.append(np.frombuffer(s, np.int64, m)[at])
            ns.append(np.frombuffer(s, np.int32, m, 8 * m)[at])
        x, s, n = map(np.concatenate, (xs, ss, ns))
        order = np.lexsort((s, x))
        x, s, n = x[order], s[order], n[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1])
        x, s, n = x[new], s[new], n[new]
        first = np.ones(len(x), bool)
        first[1:] = x[1:] != x[:-1]
        at = np.flatnonzero(first)
        freq = np.diff(np.append(at, len(x)))
        df = np.repeat(freq, freq)
        on = df > 1
        x, s, n, df = x[on], s[on], n[on], df[on]
        rows = _by_home(x, s, n, df, homes)
        return pd.DataFrame(rows, columns=["q", "who", "x", "df"])

    return entries.groupBy("r").applyInPandas(run, "q long, who binary, x binary, df binary")


def prefix_sets(shared: DataFrame, percent: int) -> DataFrame:
    """Sets that can still have a partner: set_id, n, own (unshared shingles), x (shared ones, by frequency then hash), p (prefix places left)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, sizes, xs, dfs = [], [], [], []
        for who, x, df in zip(pdf["who"], pdf["x"], pdf["df"], strict=True):
            w = np.frombuffer(who, np.int64).reshape(3, -1)
            sets.append(np.repeat(w[0], w[2]))
            sizes.append(np.repeat(w[1], w[2]))
            xs.append(np.frombuffer(x, U64))
            dfs.append(np.frombuffer(df, np.int64))
        s, n, x, df = map(np.concatenate, (sets, sizes, xs, dfs))
        # only sets with prefix places left are sorted further
        who, inverse, shared_n = np.unique(s, return_inverse=True, return_counts=True)
        size = np.zeros(len(who), np.int64)
        size[inverse] = n
        own = size - shared_n
        left = size - -(-percent * size // 100) + 1 - own
        on = (left > 0)[inverse]
        x, df, g = x[on], df[on], inverse[on]
        order = np.lexsort((x, df, g))
        x, df, g = x[order], df[order], g[order]
        bound = np.searchsorted(g, np.arange(len(who) + 1))
        rows = []
        for i in np.flatnonzero(left > 0):
            a, b = bound[i], bound[i + 1]
            rows.append((int(who[i]), int(size[i]), int(own[i]), int(min(left[i], b - a)), x[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["set_id", "n", "own", "p", "x"])

    return shared.groupBy("q").applyInPandas(run, "set_id long, n long, own long, p long, x binary")


def lists(cand: DataFrame, label: str | None = None) -> DataFrame:
    """The inverted lists of the prefixes as rows (h, set_id, n, own, place)."""
    extra = [label] if label else []
    picked = cand.select("set_id", "n", "own", "p", "x", *extra)
    kinds = "h long, set_id long, n long, own long, place long" + (", label long" if label else "")

    def run(batches):
        for b in batches:
            s, n, own, p = (b.column(i).to_numpy() for i in range(4))
            p = p.astype(np.int64)
            if not len(s):
                continue
            h = np.concatenate([np.frombuffer(x.as_buffer(), np.int64, int(c)) for x, c in zip(b.column(4), p, strict=True)])
            at = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            cols = [h, np.repeat(s, p), np.repeat(n, p), np.repeat(own, p), at + np.repeat(own, p)]
            if label:
                cols.append(np.repeat(b.column(5).to_numpy(), p))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in kinds.split(", ")])

    return picked.mapInArrow(run, kinds)


def star_candidates(entries: DataFrame) -> DataFrame:
    """Each set of a list with the list's hub: the set with the fewest shingles of its own. As many rows as entries at most."""
    hubs = entries.groupBy("h").agg(F.min(F.struct("own", "set_id", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", F.col("hub.set_id").alias("b"), F.col("hub.n").alias("bn"))
    return entries.join(hubs, "h").where("set_id <> b").select(F.col("set_id").alias("a"), "b").distinct()


def cross_candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list that lie in different components and pass the size, place and own-shingle bounds.

    Lists within one component are gone before any grouping; a list's sets are walked in blocks by size.
    """
    mixed = entries.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    cols = ["h", "set_id", "n", "own", "place", "label"]
    ordered = entries.join(mixed, "h").select(*cols).repartition("h").sortWithinPartitions("h", "n", "set_id")

    def run(batches):
        held = None
        for batch in batches:
            part = [c.to_numpy() for c in batch.columns]
            part = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            last = int(np.searchsorted(part[0], part[0][-1]))  # the list that goes on in the next batch
            held = [c[last:] for c in part]
            yield from _pairs([c[:last] for c in part], percent)
        if held is not None:
            yield from _pairs(held, percent)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _pairs(cols: list[np.ndarray], percent: int):
    """Candidate pairs of whole lists, sorted by list and size: short lists all at once, long ones block by block."""
    h, s, n, own, place, lab = cols
    if not len(h):
        return
    last = n - place  # shingles from this place on
    free = n - own  # shingles any partner may hold
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    end = np.append(start[1:], len(h))
    found = []

    def test(i: np.ndarray, j: np.ndarray) -> None:
        want = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = (lab[i] != lab[j]) & (np.minimum(last[i], last[j]) >= want) & (np.minimum(free[i], free[j]) >= want)
        found.append((s[i[ok]], s[j[ok]]))

    bound = np.repeat(end, end - start)
    i, step = np.flatnonzero(bound - np.repeat(start, end - start) <= BLOCK), 1
    while len(i):
        i = i[(i + step < bound[i])]
        i = i[100 * n[i] >= percent * n[i + step]]  # sizes rise along a list, so later ones fail too
        test(i, i + step)
        step += 1
    for lo, hi in zip(start, end, strict=True):
        if hi - lo <= BLOCK:
            continue
        cuts = np.arange(lo, hi, BLOCK)
        top_last, top_free = np.maximum.reduceat(last[:hi], cuts), np.maximum.reduceat(free[:hi], cuts)
        low_lab, high_lab = np.minimum.reduceat(lab[:hi], cuts), np.maximum.reduceat(lab[:hi], cuts)
        for k in range(lo, hi - 1):
            q = (k + 1 - lo) // BLOCK
            need = -(-percent * (n[k] + n[cuts[q:]]) // (100 + percent))
            on = (100 * n[k] >= percent * n[cuts[q:]]) & (np.minimum(last[k], top_last[q:]) >= need) & (np.minimum(free[k], top_free[q:]) >= need)
            on &= (low_lab[q:] != lab[k]) | (high_lab[q:] != lab[k])
            for c in cuts[q:][on]:
                j = np.arange(max(k + 1, c), min(hi, c + BLOCK))
                test(np.full(len(j), k), j)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(a):
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def verified(pairs: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by exact overlap of their shared shingles."""
    left = cand.select(F.col("set_id").alias("a"), F.col("n").alias("an"), F.col("x").alias("ax"))
    right = cand.select(F.col("set_id").alias("b"), F.col("n").alias("bn"), F.col("x").alias("bx"))
    sized = pairs.join(cand.select(F.col("set_id").alias("a"), F.col("n").alias("an0")), "a").join(cand.select(F.col("set_id").alias("b"), F.col("n").alias("bn0")), "b")
    sized = sized.where(100 * F.least("an0", "bn0") >= percent * F.greatest("an0", "bn0")).select("a", "b")
    both = sized.join(left, "a").join(right, "b")

    def run(batches):
        for batch in batches:
            a, b, an, bn = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("a", "b", "an", "bn"))
            ax, bx = (batch.column(batch.schema.get_field_index(c)) for c in ("ax", "bx"))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                u, v = np.frombuffer(ax[i].as_buffer(), U64), np.frombuffer(bx[i].as_buffer(), U64)
                o = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                keep[i] = 100 * o >= percent * (an[i] + bn[i] - o)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return both.select("a", "b", "an", "bn", "ax", "bx").mapInArrow(run, "a long, b long")


def bare(df: DataFrame) -> DataFrame:
    """cut(df) without the planner's constraints, which a checkpoint keeps and which would double with every round."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(cut(df)._jdf.toJavaRDD(), df._jdf.schema()), spark)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, label): label is the least set_id that links reach.

    Rounds over labels, cut by checkpoints, until none changes: a label that a link shows a lesser one takes it as its
    parent (the least of all its sets' links), parents are followed to their roots by pointer jumping, and links move to
    the roots; those within one root go. A root that neither takes nor is taken in a round is taken in the next, so roots
    with links halve at least every two rounds.
    """
    edges = bare(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = bare(edges.select(F.col("a").alias("set_id")).union(edges.select("b")).distinct().withColumn("label", F.col("set_id")))
    while not edges.isEmpty():
        parent = edges.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("p"))  # every p < r: no circles
        roots = edges.select(F.col("a").alias("r")).union(edges.select(F.col("b"))).distinct()
        to = bare(roots.join(parent, "r", "left").select("r", F.coalesce("p", "r").alias("p")))
        while True:
            up = to.select(F.col("r").alias("p"), F.col("p").alias("far"))
            jumped = bare(to.join(up, "p").select("r", F.col("far").alias("p"), (F.col("far") != F.col("p")).alias("moved")))
            to = jumped.select("r", "p")
            if jumped.where("moved").isEmpty():
                break
        label = bare(label.join(to.select(F.col("r").alias("label"), "p"), "label", "left").select("set_id", F.coalesce("p", "label").alias("label")))
        e = edges.join(to.select(F.col("r").alias("a"), F.col("p").alias("x")), "a").join(to.select(F.col("r").alias("b"), F.col("p").alias("y")), "b")
        edges = bare(e.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return nodes.join(label, "set_id", "left").select(*[F.col(c) for c in nodes.columns], F.coalesce("label", "set_id").alias("label"))


def linked_sets(docs: DataFrame, *, text="text", k=5, percent=80, range_bytes=8 << 20, frequent_least=4096) -> tuple[DataFrame, DataFrame]:
    """(candidate sets, links): every linked pair of different components' sets, and enough links to join the rest."""
    total = small_batches(docs).agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    known = frequent_shingles(docs, text, k, frequent_least)
    frequent = docs.sparkSession.sparkContext.broadcast(known) if len(known[0]) else None
    shared = shared_shingles(index_entries(docs, text, k, ranges, frequent), ranges, ranges)
    if frequent is not None:
        shared = shared.unionByName(frequent_entries(docs, text, k, frequent, ranges))
    cand = cut(prefix_sets(shared, percent))
    star = cut(verified(star_candidates(lists(cand)), cand, percent))
    labelled = cut(components(cand, star))
    cross = verified(cross_candidates(lists(labelled, "label"), percent), cand, percent)
    return labelled, cut(star.union(cross))


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", k=5, percent=80, range_bytes=8 << 20, frequent_least=4096) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows = cut(documents_to_sets(docs, doc_id, text, k))
    cand, links = linked_sets(docs, text=text, k=k, percent=percent, range_bytes=range_bytes, frequent_least=frequent_least)
    label = components(links.select(F.col("a").alias("set_id")).union(links.select(F.col("b").alias("set_id"))).distinct(), links)
    sets = rows.where("n > 0").groupBy("set_id").agg(F.min("doc").alias("least")).join(label, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    groups = sets.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(sets.join(groups, "label").select("set_id", "component_id"))
    full = rows.where("n > 0").join(named, "set_id").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return full.unionByName(empty)


def one_per_group(docs: DataFrame, *, doc_id="doc_id", text="text", k=5, percent=80) -> DataFrame:
    """The documents, one of each group of linked ones: that with the least doc_id; of rows that repeat, one."""
    found = cut(near_duplicates(docs, doc_id=doc_id, text=text, k=k, percent=percent))
    others = found.where(F.col("component_id") != F.col(doc_id)).select(doc_id).distinct()
    kept = docs.join(others, doc_id, "left_anti").select(*docs.columns)
    twice = found.groupBy(doc_id).count().where(F.col("count") > 1).select(doc_id)
    if twice.isEmpty():
        return kept
    once = kept.join(twice, doc_id, "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(twice, doc_id, "left_semi").select(*docs.columns).dropDuplicates([doc_id, text]))
