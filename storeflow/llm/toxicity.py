"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed words, word pairs and pairs with one word between, each counted once per text.
Training is online: one task streams a bounded sample of the labelled rows (about `max_rows`, twice that at most), each
of `epochs` times in an order by a hash, whatever the number of labels, and keeps only per-coordinate sums (z, n), so
its memory is the table of 2**bits coordinates. L1 leaves few weights; those that are not zero are collected (at most 2**bits) and broadcast, and every text is scored where it
is read, without a shuffle.

Defined results: null and empty texts have no features and score the bias; a label that is null is not learnt from;
with no usable label every score is 0 (nothing to learn from is nothing to reject); a doc_id that repeats in labels
is taught by each of its labels; ties and repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, U64, buffers, filter_text, map_text, mix, word_table


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.05
    max_rows: int = 24_000
    epochs: int = 4
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    """Weights that are not zero, by coordinate; `dense` is made in each process that scores."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float
    trained: bool

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def coordinates(h: np.ndarray, doc: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coordinate, document) of words, word pairs, and pairs with one word between."""
    out = []
    for kind, gap in ((1, 0), (2, 1), (3, 2)):
        if gap:
            same = doc[:-gap] == doc[gap:] if len(h) > gap else np.zeros(0, bool)
            x = (h[:-gap] * U64(0x9E3779B97F4A7C15) + h[gap:] + U64(kind))[same] if len(same) else np.zeros(0, U64)
            d = doc[:-gap][same] if len(same) else np.zeros(0, np.int64)
        else:
            x, d = h, doc
        out.append(((mix(x) >> U64(64 - bits)).astype(np.int64), d))
    return out


def features(col: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct coordinates of each text."""
    n = len(col)
    h, doc = word_table(*buffers(col), ALNUM)
    parts = coordinates(h, doc, bits)
    key = np.unique(np.concatenate([(d << bits) | x for x, d in parts])) if len(h) else np.zeros(0, np.int64)
    bounds = np.searchsorted(key, np.arange(n + 1) << bits)
    key &= (1 << bits) - 1
    return [key[bounds[i] : bounds[i + 1]] for i in range(n)]


class Ftrl:
    def __init__(self, s: Settings):
        self.s = s
        self.z, self.n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[i]
        l1 = np.where(i == 1 << s.bits, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((s.beta + np.sqrt(self.n[i])) / s.alpha + s.l2))

    def learn(self, x: np.ndarray, y: float) -> None:
        i = np.append(x, 1 << self.s.bits)  # the last coordinate is the bias
        w = self.weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        was = self.n[i]
        self.n[i] = was + g * g
        self.z[i] += g - (np.sqrt(self.n[i]) - np.sqrt(was)) / self.s.alpha * w

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(np.abs(self.z) > 0)
        w = self.weights(i)
        return i[w != 0], w[w != 0]


def train(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", settings: Settings = Settings()) -> Model:
    """Fit on at most about `max_rows` labelled rows, chosen by a hash of doc_id; labels is filtered by the caller."""
    s = settings
    lab = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("k"), F.col(label).cast("double").alias("y"))
    total = lab.count()
    if not total:
        return Model(s.bits, np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, False)
    share = min(1.0, s.max_rows / total)
    lab = lab.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * s.max_rows)  # a bound even where ids repeat
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(lab), "k")  # lab is bounded
    found = map_text(rows, "t", {"k": "k", "y": "y"}, [("x", "binary")], lambda col: [[v.astype(np.int32).tobytes() for v in features(col, s.bits)]])
    turns = found.select("*", F.explode(F.sequence(F.lit(1), F.lit(s.epochs))).alias("epoch"))
    ordered = turns.repartition(1).sortWithinPartitions("epoch", F.xxhash64("k", F.col("epoch")), "k", "y", "x").select("y", "x")

    def fit(batches):
        model = Ftrl(s)
        for b in batches:
            for y, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                model.learn(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64), y)
        i, w = model.compact()
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, pa.float64())], names=["i", "w"])

    got = ordered.mapInArrow(fit, "i long, w double").toPandas()  # at most 2**bits rows; L1 leaves far fewer
    i, w = got["i"].to_numpy(np.int64), got["w"].to_numpy(float)
    bias = float(w[i == 1 << s.bits].sum())
    keep = i < 1 << s.bits
    return Model(s.bits, i[keep], w[keep].astype(np.float32), bias, True)


_DENSE: dict[int, tuple] = {}


def score_texts(col: pa.Array, model: Model) -> np.ndarray:
    if not model.trained:
        return np.zeros(len(col))
    if _DENSE.get(0, (None,))[0] is not model:
        _DENSE[0] = (model, model.dense())
    w = _DENSE[0][1]
    h, doc = word_table(*buffers(col), ALNUM)
    keys = []
    for x, d in coordinates(h, doc, model.bits):
        hot = np.flatnonzero(w[x])
        keys.append((d[hot] << model.bits) | x[hot])
    key = np.unique(np.concatenate(keys))
    total = np.bincount(key >> model.bits, weights=w[key & ((1 << model.bits) - 1)], minlength=len(col)) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, *, doc_id="doc_id", text="text", threshold=0.5) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(col):
        p = score_texts(col, sent.value)
        return p, (p >= threshold).astype(np.int32)

    return map_text(docs, text, {doc_id: doc_id}, [("score", "double"), ("predicted", "int")], judge)


def drop_toxic(docs: DataFrame, model: Model, *, text="text", threshold=0.5) -> DataFrame:
    """The documents that score below the threshold, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filter_text(docs, text, lambda col: score_texts(col, sent.value) < threshold)


def training_labels(labels: DataFrame, doc_id="doc_id") -> DataFrame:
    """The rows that may be learnt from: crc32 of the id's text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0)
