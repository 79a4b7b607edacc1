"""Hard negatives by a vertical scan (BOND): dimensions are columns, read for each anchor from its largest component down.

For an anchor a and a block of rows, after some dimensions a row's score lies between its partial sum plus the least and
plus the greatest that the remaining dimensions can add, by the block's minimum and maximum of each. A bitmap of candidates
loses the rows whose interval cannot matter; what is left after the last dimension has its exact score. The scan runs
twice: rows of the anchor's label against the k-th best score so far give its positives; then rows of other labels against
the windows that the positives' scores open, and the best scores found in them so far, give the negatives.

Anchors come in slices of at most `slice_bytes`, which are broadcast; each slice reads all rows twice, in blocks of
an Arrow batch. A task holds one block and, for each anchor of the slice, its best rows so far; these meet by anchor.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; components beyond
the range of a long are set to its ends, and so are scores; vectors of other lengths are compared over the dimensions both
have; other rows are those of another id, so repeated rows of an anchor are anchors of their own, with equal results, and no
positives of each other, while a positive that repeats is listed each time; a null id counts as the greatest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import shared_dir

STEP = 8
LAST_ID = (1 << 63) - 1
#: Scores below this are exact in doubles; others are computed with whole numbers of any size.
EXACT = 1 << 53


def integers(rows: DataFrame, *, row_id="vec_id", vector="embedding", label="label", scale=256) -> DataFrame:
    """(id, label, v) of the rows that take part: v holds floor(scale * x) of each component."""
    v = F.col(f"`{vector}`")
    sound = v.isNotNull() & F.col(f"`{label}`").isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return rows.where(sound).select(F.coalesce(F.col(f"`{row_id}`").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), whole.alias("v"))


def matrix(col: pa.Array) -> np.ndarray:
    """Vectors as the columns of an array, with zeros after the shorter ones."""
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    flat, d = col.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    if (sizes == d).all():
        return np.ascontiguousarray(flat.reshape(len(sizes), d).T)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ascontiguousarray(out.T)


class Block:
    """Rows in order of label, dimension by dimension, with the least and greatest value of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.columns = ids[order], labels[order], columns[:, order]
        self.most = max((abs(int(x)) for x in (columns.min(initial=0), columns.max(initial=0))), default=0)
        self.kinds: dict = {}

    def as_kind(self, kind):
        if kind not in self.kinds:
            c = self.columns.astype(kind)
            self.kinds[kind] = c, c.min(axis=1), c.max(axis=1)
        return self.kinds[kind]

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def scan(anchor: np.ndarray, block: Block, where: slice, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the rows of block[where] that are alive and that `keep` never gives up.

    keep(low, high) gets bounds of the scores of the rows held, and returns which may still matter.
    """
    d = min(len(anchor), len(block.columns))
    kind = float if d * block.most * max((abs(int(x)) for x in anchor), default=0) < EXACT else object
    columns, least, greatest = block.as_kind(kind)
    a = anchor[:d].astype(kind)
    order = np.argsort([-abs(int(x)) for x in anchor[:d]], kind="stable")
    ends = np.stack([a * least[:d], a * greatest[:d]])[:, order]
    rest = [np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (ends.min(axis=0), ends.max(axis=0))]
    places, held = np.arange(where.start, where.stop), columns[:d, where]
    if 4 * alive.sum() < len(alive):
        places, held, alive = places[alive], held[:, alive], alive[alive]
    part = np.zeros(len(places), kind)
    for k in range(0, d, STEP):
        dims = order[k : k + STEP]
        part = part + a[dims] @ held[dims]
        k += len(dims)
        alive &= keep(part + rest[0][k], part + rest[1][k], alive)
        if not alive.any():
            break
        if 4 * alive.sum() < len(alive):
            places, held, part, alive = places[alive], held[:, alive], part[alive], alive[alive]
    return places[alive], part[alive]


def best(ids, scores, k: int):
    """The k greatest scores, ties by smaller id."""
    if len(ids) > k:
        if scores.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), int)[:k]
        else:
            order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]
    return ids, scores


def _append(held, ids, scores, k):
    if held is None:
        return best(ids, scores, k)
    kind = object if object in (held[1].dtype, scores.dtype) else float
    return best(np.concatenate([held[0], ids]), np.concatenate([held[1].astype(kind), scores.astype(kind)]), k)


def _long(x) -> int:
    return max(-(1 << 63), min(LAST_ID, int(x)))


def _exact(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype == object else np.array([int(x) for x in scores], object)


def find_positives(anchors: tuple, blocks, k: int):
    """For each anchor (its place, then id and score) the k best rows of its label and of other ids."""
    ids, labels, vectors = anchors
    held = [None] * len(ids)
    for block in blocks:
        for i in range(len(ids)):
            where = block.of_label(int(labels[i]))
            if where.start == where.stop:
                continue
            floor = held[i][1].min() if held[i] is not None and len(held[i][0]) == k else None

            def keep(low, high, alive, floor=floor):
                now = low[alive]
                if len(now) >= k:
                    kth = np.sort(now)[-k] if now.dtype == object else np.partition(now, -k)[-k]
                    floor = kth if floor is None else max(floor, kth)
                return alive if floor is None else (high >= floor).astype(bool)

            places, scores = scan(vectors[:, i], block, where, block.ids[where] != ids[i], keep)
            if len(places):
                held[i] = _append(held[i], block.ids[places], scores, k)
    return held


def find_negatives(anchors: tuple, windows: list, blocks, k: int):
    """For each anchor and each of its windows (least, greatest score) the k best rows of other labels inside."""
    ids, labels, vectors = anchors
    held = [[None] * len(w) for w in windows]
    for block in blocks:
        for i, mine in enumerate(windows):
            open_ = [(low if got is None or len(got[0]) < k else max(low, got[1].min()), high) for (low, high), got in zip(mine, held[i], strict=True) if low <= high]
            if not open_:
                continue
            least, greatest = min(x for x, _ in open_), max(x for _, x in open_)
            same = block.of_label(int(labels[i]))
            alive = np.ones(len(block.ids), bool)
            alive[same] = False
            places, scores = scan(vectors[:, i], block, slice(0, len(alive)), alive, lambda low, high, _: ((high >= least) & (low <= greatest)).astype(bool))
            for j, (low, high) in enumerate(mine):
                inside = ((scores >= low) & (scores <= high)).astype(bool)
                if inside.any():
                    held[i][j] = _append(held[i][j], block.ids[places[inside]], scores[inside], k)
    return held


def _blocks(batches):
    for b in batches:
        if b.num_rows:
            yield Block(b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)))


def _number(rows_per_block: int):
    """Anchors with the block they belong to, whose size is bounded."""

    def run(batches):
        from pyspark import TaskContext

        block, filled = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, rows_per_block - filled)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), *part.columns], names=["block", "id", "label", "v"])
                at, filled = at + part.num_rows, filled + part.num_rows
                if filled == rows_per_block:
                    block, filled = block + 1, 0

    return run


def mine(rows: DataFrame, anchors: Column, *, positives=5, negatives=3, low=50, high=95, slice_bytes=32 << 20, rows_per_block=4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from the rows (id, label, v) of `integers`.

    anchors picks the anchors by columns of rows. A negative's score is from low to high percent of the positive's.
    """
    spark = rows.sparkSession
    root = shared_dir(spark, "hardneg")
    rows.select("id", "label", "v").write.parquet(f"{root}/rows")
    stored = spark.read.parquet(f"{root}/rows").select("id", "label", "v")
    stored.where(anchors).mapInArrow(_number(rows_per_block), "block long, id long, label long, v array<long>").write.parquet(f"{root}/anchors")
    chosen = spark.read.parquet(f"{root}/anchors")
    sizes = chosen.groupBy("block").agg(F.sum(F.size("v") * 8 + 200).alias("n")).orderBy("block").collect()  # a row for every 4096 anchors
    slices, filled = [], 0
    for r in sizes:
        if not slices or filled + r["n"] > slice_bytes:
            slices.append([r["block"], r["block"]])
            filled = 0
        slices[-1][1], filled = r["block"], filled + r["n"]
    for n, (first, last) in enumerate(slices):
        _mine_slice(stored, chosen.where(F.col("block").between(first, last)).select("id", "label", "v"), positives, negatives, low, high, f"{root}/found/slice={n}")
    if not slices:
        _mine_slice(stored, chosen.select("id", "label", "v"), positives, negatives, low, high, f"{root}/found/slice=0")
    ids = [F.expr(f"nullif({c}, {LAST_ID})").alias(c) for c in ("anchor_id", "positive_id", "negative_id")]
    return spark.read.parquet(f"{root}/found").select(ids[0], ids[1], "rank", ids[2], "positive_score", "negative_score")


def _mine_slice(stored: DataFrame, chosen: DataFrame, k: int, m: int, low: int, high: int, path: str) -> None:
    sc = stored.sparkSession.sparkContext
    got = chosen.toArrow().combine_chunks()  # at most slice_bytes
    sent = sc.broadcast((got.column(0).to_numpy(), got.column(1).to_numpy(), matrix(got.column(2).combine_chunks() if isinstance(got.column(2), pa.ChunkedArray) else got.column(2))))

    def first(batches):
        found = find_positives(sent.value, _blocks(batches), k)
        rows = [(i, int(p), _long(s)) for i, x in enumerate(found) if x is not None for p, s in zip(x[0], x[1], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["anchor", "id", "score"])

    by = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    ranked = stored.mapInArrow(first, "anchor long, id long, score long").select("*", F.row_number().over(by).alias("k")).where(F.col("k") <= k)
    best_rows = ranked.orderBy("anchor", "k").toArrow()  # at most k for each anchor of the slice
    mine: list[list] = [[] for _ in range(got.num_rows)]
    for a, p, s in zip(*(best_rows.column(c).to_pylist() for c in ("anchor", "id", "score")), strict=True):
        mine[a].append((p, s))
    opened = sc.broadcast(mine)

    def second(batches):
        pairs = opened.value
        windows = [[(-(-low * s // 100), high * s // 100) for _, s in x] for x in pairs]
        found = find_negatives(sent.value, windows, _blocks(batches), m)
        ids = sent.value[0]
        rows = [(i, j, int(ids[i]), *pairs[i][j], int(p), _long(s)) for i, x in enumerate(found) for j, y in enumerate(x) if y is not None for p, s in zip(y[0], y[1], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(7)], names=["anchor", "n", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    by = Window.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "negative_id")
    made = stored.mapInArrow(second, "anchor long, n long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    made.select("*", F.row_number().over(by).alias("rank")).where(F.col("rank") <= m).drop("anchor", "n").write.parquet(path)
    sent.destroy()
    opened.destroy()
