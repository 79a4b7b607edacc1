"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

Symbols are words. Patterns of one length m share a shift table over blocks of two words: where the block that ends
at the probe can be in no pattern, the probe jumps by up to m - 1 words; a shift of zero selects the bucket of
patterns with that last block. What is left is compared directly: first the words' hashes, then their bytes, so two
words that happen to share a hash are no occurrence. All stretches of a slice of texts are probed together.

The benchmark is read once, row by row, and cut into blocks of about `block_bytes` of text (a longer item is a block of
its own). A block's tables are broadcast, the documents are searched, and then its tables go: a task holds one block at
a time, the driver two at most. With one block, documents are judged where they are read. With more, the words hit and
the items found are written after each block under the text's SHA-256, and meet by it at the end.

Defined results: null and empty texts have no words and no hits; items without words never occur; rows that repeat
are judged each by itself; an item_id that repeats counts once; a null item_id is written as an empty string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, FOLD, U64, buffers, cut, filter_text, fresh, map_text, mix, slices, small_batches, word_spans

LANE = 192
FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
FOUND = "key string, spans array<struct<a:bigint,b:bigint>>, items array<string>"


def same_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether each stretch data[start:start+size], folded, equals its other; stretches are not empty."""
    out = size == other_size
    i = np.flatnonzero(out)
    if len(i):
        n = size[i]
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        equal = FOLD[data[np.repeat(start[i], n) + step]] == other[np.repeat(other_start[i], n) + step]
        out[i] = np.logical_and.reduceat(equal, first)
    return out


class Vocabulary:
    """The distinct words of a block, as bytes, with their hashes."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.hash: list[int] = []

    def of(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        h, _, start, size = word_spans(data, np.array([0, len(data)], np.int64), ALNUM)
        raw = FOLD[data].tobytes()
        out = np.empty(len(h), np.int32)
        for k, (x, a, n) in enumerate(zip(h.tolist(), start.tolist(), size.tolist(), strict=True)):
            word = raw[a : a + n]
            if word not in self.ids:
                self.ids[word] = len(self.hash)
                self.hash.append(x)
            out[k] = self.ids[word]
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, bytes, first byte, length) of all words."""
        size = np.array([len(w) for w in self.ids], np.int64)
        return np.array(self.hash, U64), np.frombuffer(b"".join(self.ids), np.uint8), np.cumsum(size) - size, size


class Patterns:
    """Wu-Manber tables of the windows that have one length."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, owners: list[list[str]]):
        self.ids, self.owners = ids, owners
        self.windows = windows = hashes[ids]
        self.m = m = windows.shape[1]
        self.block = b = min(2, m)
        self.bits = max(12, int(np.ceil(np.log2(16 * max(1, windows.size)))))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int16)
        for end in range(b - 1, m):
            np.minimum.at(self.shift, self._slot(self._blocks(windows, end)), m - 1 - end)
        last = self._blocks(windows, m - 1)
        order = np.argsort(last, kind="stable")
        self.last, self.order = last[order], order

    def _blocks(self, w: np.ndarray, end: int) -> np.ndarray:
        return mix(w[:, end] if self.block == 1 else w[:, end - 1] * U64(0x9E3779B97F4A7C15) + w[:, end])

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> U64(64 - self.bits)).astype(np.int64)

    def search(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every place inside one document whose word hashes are a window's."""
        n, m = len(h), self.m
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n < m:
            return none
        probe = np.arange(0, n, LANE) + m - 1
        stop = np.minimum(probe + LANE, n)
        ends, lefts, rights = [], [], []
        while len(probe):
            on = probe < stop
            if not on.all():
                probe, stop = probe[on], stop[on]
            if not len(probe):
                break
            block = mix(h[probe] if self.block == 1 else h[probe - 1] * U64(0x9E3779B97F4A7C15) + h[probe])
            jump = self.shift[self._slot(block)]
            zero = np.flatnonzero(jump == 0)
            if len(zero):
                left = np.searchsorted(self.last, block[zero], "left")
                right = np.searchsorted(self.last, block[zero], "right")
                some = right > left
                ends.append(probe[zero][some])
                lefts.append(left[some])
                rights.append(right[some])
            probe = probe + np.maximum(jump, 1)
        if not ends:
            return none
        end, left, right = map(np.concatenate, (ends, lefts, rights))
        count = right - left
        at = np.repeat(end, count) - m + 1
        which = self.order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)]
        good = doc[at] == doc[at + m - 1]
        at, which = at[good], which[good]
        for k in range(m):
            same = h[at + k] == self.windows[which, k]
            at, which = at[same], which[same]
        return at, which


class Block:
    """Search tables of some benchmark items, given as (id, text)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        words = Vocabulary()
        by_length: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = words.of(text or "")
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(ids[i : i + m].tobytes(), set()).add(item)
        self.hashes, self.raw, self.start, self.size = words.tables()
        self.groups = [Patterns(np.frombuffer(b"".join(found), np.int32).reshape(-1, m), self.hashes, [sorted(x) for x in found.values()]) for m, found in sorted(by_length.items())]

    def occurrences(self, data: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray):
        """(patterns, first words, windows) of what occurs, compared byte by byte; each word of a text once."""
        for p in self.groups:
            at, which = p.search(h, doc)
            if not len(at):
                continue
            place = at[:, None] + np.arange(p.m)
            pair, back = np.unique(place.ravel() * len(self.size) + p.ids[which].ravel(), return_inverse=True)
            w, v = pair // len(self.size), pair % len(self.size)
            good = same_bytes(data, start[w], size[w], self.raw, self.start[v], self.size[v])[back].reshape(-1, p.m).all(1)
            yield p, at[good], which[good]


def search_texts(col: pa.Array, block: Block | None) -> tuple[np.ndarray, np.ndarray, list[set[str]], np.ndarray, np.ndarray]:
    """Per text: words, words hit, and the ids of the items that occur; then which words are hit, and each word's text."""
    data, offsets = buffers(col)
    h, doc, start, size = word_spans(data, offsets, ALNUM)
    n = len(col)
    cover = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    for p, at, which in block.occurrences(data, h, doc, start, size) if block else ():
        np.add.at(cover, at, 1)
        np.add.at(cover, at + p.m, -1)
        for pair in np.unique(doc[at] * len(p.owners) + which):
            items[pair // len(p.owners)].update(p.owners[pair % len(p.owners)])
    hit = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc, minlength=n), np.bincount(doc[hit], minlength=n), items, hit, doc


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int):
    """Broadcasts of Block, one after another; each holds about `block_bytes` of text, and is gone when the next one comes."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    send = benchmark.sparkSession.sparkContext.broadcast
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t or "")
        if size >= block_bytes:
            yield send(Block(held, window))
            held, size = [], 0
    if held:
        yield send(Block(held, window))


def found_in(docs: DataFrame, text: str, block) -> DataFrame:
    """FOUND of the texts in which the block's items occur; equal texts are one row."""
    picked = small_batches(docs).select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(0)):
                part = batch.column(0).slice(i, j - i)
                _, n_hit, items, hit, doc = search_texts(part, block.value)
                begin = np.searchsorted(doc, np.arange(len(part) + 1))
                rows = []
                for k in np.flatnonzero(n_hit):
                    on = np.concatenate([[False], hit[begin[k] : begin[k + 1]], [False]]).astype(np.int8)
                    edge = np.flatnonzero(np.diff(on)).tolist()
                    rows.append({"key": hashlib.sha256(part[int(k)].as_py().encode()).hexdigest(), "spans": [{"a": a, "b": b} for a, b in zip(edge[::2], edge[1::2], strict=True)], "items": sorted(items[k])})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))]))

    return picked.mapInArrow(run, FOUND).groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))


def found_in_blocks(docs: DataFrame, text: str, first, second, rest) -> DataFrame:
    """key, n_hit, items of the texts in which any block's items occur: one pass over the documents a block."""
    out = None
    for block in (b for part in ((first, second), rest) for b in part):
        part = cut(found_in(docs, text, block))
        block.destroy()
        out = part if out is None else out.unionByName(part)
    met = out.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a block
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    total = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")), lambda s: s["n"])
    return cut(met.select("key", total.alias("n_hit"), "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=10, block_bytes=2 << 20) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    tables = blocks(benchmark, item_id, item_text, window, block_bytes)
    first, second = next(tables, None), next(tables, None)
    if second is None:

        def judge(col: pa.Array):
            words, hit, items, _, _ = search_texts(col, first.value if first is not None else None)
            digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            return words, hit, np.array([len(x) for x in items], np.int64), digests, hit > 0

        return map_text(docs, text, {doc_id: doc_id}, FIELDS, judge)
    found = found_in_blocks(docs, text, first, second, tables)
    picked = docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").cast("string").alias("t"))
    keyed = map_text(picked, "t", {doc_id: doc_id}, [("n_words", "bigint"), ("key", "string")], lambda col: (search_texts(col, None)[0], [hashlib.sha256((t or "").encode()).hexdigest() for t in col.to_pylist()]))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return keyed.join(found, "key", "left").select(doc_id, "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", item_text="text", window=10, block_bytes=2 << 20) -> DataFrame:
    """The documents that hold no window of any benchmark item, all columns as they are."""
    tables = blocks(benchmark, item_id, item_text, window, block_bytes)
    first, second = next(tables, None), next(tables, None)
    if first is None:
        return docs
    if second is None:
        return filter_text(docs, text, lambda col: search_texts(col, first.value)[1] == 0)
    key = fresh(docs, "key")
    bad = found_in_blocks(docs, text, first, second, tables).select(F.col("key").alias(key))
    return docs.withColumn(key, F.sha2(F.col(f"`{text}`").cast("string").cast("binary"), 256)).join(bad, key, "left_anti").drop(key)
