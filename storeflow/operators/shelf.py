"""Shelf changes and dataset rules that depend on their own output."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import pieces
from .grouped import grouped, listed


def match_slots(before: list[tuple], after: list[tuple], gate: float, penalty: float = 0.3) -> list[tuple]:
    """Cheapest pairs first of slots (id, x, y, size, label): distance over the mean size, plus a penalty for another label."""
    costs = []
    for a in before:
        for b in after:
            c = ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 / max((a[3] + b[3]) / 2, 1e-9) + penalty * (a[4] != b[4])
            if c <= gate:
                costs.append((c, a[0], b[0]))
    used_a, used_b, out = set(), set(), []
    for c, a, b in sorted(costs):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, c))
    return out


def slot_changes(slots: DataFrame, keys: list[str], gate: float = 0.8) -> DataFrame:
    """Slots of a visit before and after it: kept, removed or added. Rows: side, id, x, y, size, label."""

    def run(pdf):
        rows: dict[str, list[tuple]] = {"before": [], "after": []}
        for side, *slot in zip(*(pdf[c] for c in ("side", "id", "x", "y", "size", "label")), strict=True):
            rows[side].append(tuple(slot))
        pairs = match_slots(rows["before"], rows["after"], gate)
        a, b = {p[0] for p in pairs}, {p[1] for p in pairs}
        out = [("kept", x, y, float(c)) for x, y, c in pairs]
        out += [("removed", r[0], None, None) for r in rows["before"] if r[0] not in a]
        return out + [("added", None, r[0], None) for r in rows["after"] if r[0] not in b]

    return listed(slots.select(*keys, "side", "id", "x", "y", "size", "label"), keys, run, "change string, before_id long, after_id long, cost double")


def shelf_visits(frames: DataFrame, keys: list[str], time: str, tie: str, stable: int, window: int = 5) -> DataFrame:
    """Shelf monitor: while someone is in front nothing is compared; afterwards the median item count of the last
    frames must hold for `stable` before it is taken as the shelf's. Unchanged visits are kept too.

    Rows: time, occluded, items.
    """

    def run(pdf):
        known, since, recent, visit, out = None, None, [], None, []
        for t, _, hidden, n in sorted(zip(pdf[time].tolist(), pdf[tie].tolist(), pdf["occluded"].tolist(), pdf["items"].tolist(), strict=True)):
            if hidden:
                visit = (visit[0], t) if visit else (t, t)
                recent, since = [], None
                continue
            recent = [*recent, (t, n)][-window:]
            now = int(median(x for _, x in recent))
            if since is None or now != since[1]:
                since = (t, now)
            if t - since[0] >= stable and (visit or known is None):
                if visit and known is not None:
                    out.append((visit[0], visit[1], max(known - now, 0), max(now - known, 0)))
                known, visit = now, None
        return out

    return grouped(frames.select(*keys, time, tie, "occluded", "items"), keys, run, "start_ms long, end_ms long, removed int, added int")


def frame_choice(moments: DataFrame, frames: DataFrame, keys: list[str], offsets: list[tuple[str, int, int]], tolerance: int) -> DataFrame:
    """Frames near moments shifted by each (kind, offset, priority); a frame chosen twice keeps its best priority."""
    from .joins import nearest_in_time

    o = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(d).cast("bigint").alias("shift"), F.lit(p).alias("priority")) for k, d, p in offsets]))
    m = moments.select(*keys, "id", "at", o.alias("o")).select(*keys, (F.col("id") * len(offsets) + F.col("o.priority")).alias("id"), (F.col("at") + F.col("o.shift")).alias("at"), "o.kind", "o.priority")
    n = nearest_in_time(m, frames, keys, "at", "id", "frame", tolerance)
    got = m.join(n, [*keys, "at", "id"]).where("near_frame is not null")
    return got.groupBy(*keys, F.col("near_frame").alias("frame")).agg(F.min_by("kind", "priority").alias("kind"), F.min("priority").alias("priority"))


def score_takes(labels: DataFrame, episodes: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Each label's episode: one that holds it, else the nearest within reach, else the earlier; and whether its direction agrees."""
    from .sweeps import nearest_episode

    la = labels.select(*keys, F.col("id").alias("label_id"), F.col("at").alias("ls"), F.col("direction").alias("want"))
    ep = episodes.select(*keys, F.col("id").alias("episode_id"), "s", "e", F.col("direction").alias("got"))
    out = nearest_episode(la, ep, keys, "label_id", "ls", "episode_id", "s", "e", "got", reach)
    return out.select(*keys, "label_id", "episode_id", F.when(F.col("episode_id").isNull(), "MISSED").when(F.col("got").isNull(), "UNKNOWN").when(F.col("got") == F.col("want"), "RIGHT").otherwise("WRONG").alias("outcome"))


def polynomial_fit(rows: DataFrame, x: Column, y: Column, degree: int) -> DataFrame:
    """Least squares on powers of x; rows with a value that is not finite are dropped. power, coefficient."""
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    d = rows.select(x.cast("double").alias("x"), y.cast("double").alias("label")).where("x is not null and label is not null and not isnan(x) and not isnan(label) and abs(x) < double('Infinity') and abs(label) < double('Infinity')")
    v = PolynomialExpansion(degree=degree, inputCol="v", outputCol="features").transform(VectorAssembler(inputCols=["x"], outputCol="v").transform(d))
    m = LinearRegression(solver="normal", regParam=0.0).fit(v)
    return rows.sparkSession.createDataFrame([(i, float(c)) for i, c in enumerate([m.intercept, *m.coefficients])], "power int, coefficient double")


def cross_validated(rows: DataFrame, group: str, label: str, features: list[str], folds: int = 5) -> DataFrame:
    """Out-of-fold probability of every row; rows of one group share a fold (a hash of the group)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)))
    v = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(d)
    out = None
    for k in range(folds):
        m = LogisticRegression(labelCol=label, maxIter=20, regParam=0.01, standardization=True).fit(v.where(F.col("fold") != k))
        p = m.transform(v.where(F.col("fold") == k)).select(*rows.columns, "fold", vector_to_array("probability")[1].alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def hand_samples(actions: DataFrame, samples: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The samples before, at and after each action: the last before, the nearest, the first after, within reach."""
    from .joins import range_join

    a = actions.select(*keys, "action_id", F.col("at").alias("a0"), (F.col("at") - reach).alias("s"), (F.col("at") + reach).alias("e"))
    b = samples.select(*keys, F.col("at").alias("t"), F.col("at").alias("t2"), "value")
    c = range_join(a, b, keys, "s", "e", "t", "t2", max(reach, 1))
    before, after = F.col("t") < F.col("a0"), F.col("t") > F.col("a0")
    return c.groupBy(*keys, "action_id").agg(F.max_by(F.when(before, F.col("value")), F.when(before, F.col("t"))).alias("before"), F.min_by("value", F.struct(F.abs(F.col("t") - F.col("a0")), F.col("t"))).alias("mid"), F.min_by(F.when(after, F.col("value")), F.when(after, F.col("t"))).alias("after"))


def convert_boxes(boxes: DataFrame, width: Column, height: Column, classes: DataFrame) -> DataFrame:
    """Annotated boxes (name, file, x, y, w, h) as normalised rows; unknown classes and clashing file names go, first wins."""
    w = Window.partitionBy("file").orderBy("source")
    first = boxes.repartition(pieces(boxes), "file").withColumn("_s", F.first("source").over(w)).where(F.col("source") == F.col("_s")).drop("_s")
    return first.join(classes, "name").select("file", "cls", ((F.col("x") + F.col("w") / 2) / width).alias("cx"), ((F.col("y") + F.col("h") / 2) / height).alias("cy"), (F.col("w") / width).alias("bw"), (F.col("h") / height).alias("bh"))
