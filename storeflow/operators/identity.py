"""Identities over time (`people.py` holds the registry): late merges, swap repair, ledger merges, homographies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import grouped


def late_merges(people: DataFrame, keys: list[str], vector: str, least: float, retire: int) -> DataFrame:
    """from -> into: each person with the most similar one who vanished before they appeared, within the retire time.

    people: keys, person_id, first_ms, last_ms, mean vector. Joined by time buckets of the retire time.
    """
    from ..functions.geometry import cosine
    from .joins import range_join, top_one

    new = people.select(*keys, F.col("person_id").alias("from"), F.col("first_ms").alias("born"), (F.col("first_ms") - retire).alias("since"), F.col(vector).alias("_a"))
    old = people.select(*keys, F.col("person_id").alias("into"), F.col("last_ms").alias("gone"), F.col("last_ms").alias("gone2"), F.col(vector).alias("_b"))
    j = range_join(new, old, keys, "since", "born", "gone", "gone2", retire).where((F.col("from") != F.col("into")) & (F.col("gone") < F.col("born")))
    j = j.withColumn("similarity", cosine(F.col("_a"), F.col("_b"))).where(F.col("similarity") >= least)
    return top_one(j, [*keys, "from"], [F.desc(F.round("similarity", 9)), F.col("into")]).select(*keys, "from", "into", "similarity")


def swap_history(swaps: DataFrame) -> DataFrame:
    """What every id stands for after each swap: id, since, until (null: for good), is_now, of the composed exchanges.

    From `since` of a swap on, rows that are by then called a are called b, and the other way round; swaps of one time go in
    order of a and b. So a chain of swaps is a product of exchanges, taken in order. Ids that are linked by swaps
    make a component of their own; a component's product is taken in one task, over its swaps alone.
    """
    from .windows import islands

    s = swaps.where((F.col("a") != F.col("b")) & F.col("since").isNotNull()).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("since").cast("long").alias("since"))
    root = components(s.select(F.col("a").alias("x"), F.col("b").alias("y")))
    keyed = s.join(root, F.col("a") == F.col("id")).select("root", "a", "b", "since")

    def run(pdf):
        called, bearer, out = {}, {}, []  # what an id is called, and which id bears a name
        for since, rows in pdf.sort_values(["since", "a", "b"]).groupby("since", sort=True):
            touched = set()
            for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
                i, j = bearer.get(a, a), bearer.get(b, b)
                called[i], called[j], bearer[a], bearer[b] = b, a, j, i
                touched |= {i, j}
            out += [(i, int(since), called[i]) for i in sorted(touched)]
        return out

    steps = grouped(keyed, ["root"], run, "id long, since long, is_now long")
    w = Window.partitionBy("id").orderBy("since")
    runs = islands(steps, ["id"], ["since"], ~F.col("is_now").eqNullSafe(F.lag("is_now").over(w)), "run")
    spans = runs.groupBy("id", "run").agg(F.min("since").alias("since"), F.first("is_now").alias("is_now"))
    return spans.withColumn("until", F.lead("since").over(w)).select("id", "since", "until", "is_now")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root): the least id that each id of the edges (x, y) is linked to. Roots jump to their roots' roots, so rounds grow with the logarithm of a chain."""
    from ..sources.tables import shared_checkpoint

    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    near = shared_checkpoint(both)
    roots = near.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("root"))
    for _ in range(rounds):
        roots = shared_checkpoint(roots)
        of = roots.select(F.col("id").alias("y"), F.col("root").alias("r"))
        least = near.join(of, "y").groupBy(F.col("x").alias("id")).agg(F.min("r").alias("m"))
        jump = roots.select(F.col("id").alias("root"), F.col("root").alias("rr"))
        then = roots.join(least, "id").join(jump, "root").select("id", F.least("root", "m", "rr").alias("new"), F.col("root").alias("old"))
        if then.where("new <> old").isEmpty():
            return roots
        roots = then.select("id", F.col("new").alias("root"))
    raise ValueError("ids did not settle")


def relabel_since(rows: DataFrame, swaps: DataFrame, ident: str, time: str) -> DataFrame:
    """Rows with the id that each row's id stands for at its time, by `swap_history`; `was` keeps the old one."""
    spans = swap_history(swaps).groupBy(F.col("id").alias(ident)).agg(F.array_sort(F.collect_list(F.struct("since", "is_now"))).alias("_s"))
    now = F.filter("_s", lambda x: x["since"] <= F.col(time))
    return rows.join(spans, ident, "left").withColumn("was", F.col(ident)).withColumn(ident, F.coalesce(F.try_element_at(now, F.lit(-1))["is_now"], F.col(ident))).drop("_s")


def relabel_spans(spans: DataFrame, swaps: DataFrame, keys: list[str], ident: str, start: str, end: str) -> DataFrame:
    """History spans (keys, start, end, ident) cut where their id changes its meaning, relabelled, and joined again where neighbours agree (`end` excluded)."""
    h = swap_history(swaps)
    cut = spans.join(h.select(F.col("id").alias(ident), "since", "until", "is_now"), ident, "left")
    first = h.groupBy("id").agg(F.min("since").alias("t0")).select(F.col("id").alias(ident), "t0")
    before = spans.join(first, ident, "left").select(*keys, F.col(start).alias("s"), F.least(F.col(end), F.coalesce("t0", F.col(end))).alias("e"), F.col(ident).alias("who"))
    after = cut.where("since is not null").select(*keys, F.greatest(F.col(start), F.col("since")).alias("s"), F.least(F.col(end), F.coalesce("until", F.col(end))).alias("e"), F.col("is_now").alias("who"))
    parts = before.unionByName(after).where("s < e")
    w = Window.partitionBy(*keys).orderBy("s", "e", "who")
    fresh = (F.coalesce(F.lag("e").over(w), F.col("s") - 1) != F.col("s")) | ~F.col("who").eqNullSafe(F.lag("who").over(w))
    run = F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("s").alias(start), F.max("e").alias(end), F.first("who").alias(ident)).drop("_run")


def mutual_swaps(windows: DataFrame, keys: list[str], overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """Swaps of two far ids between neighbouring windows: near ids a and b had far ids x and y in two windows, and y and x in the next.

    windows: keys, n (window number, one after the other), start_ms, near, far. Kept are swaps for which the far boxes of x
    and y overlapped by `least` in the last two windows, and the near boxes of a and b did not: overlaps has keys, n,
    view (near or far), a, b (a < b), overlap. Gives keys, since, a, b (the far ids), near_a, near_b.
    """
    w = Window.partitionBy(*keys, "near").orderBy("n")
    steady = (F.lag("n", 2).over(w) == F.col("n") - 2) & (F.lag("far", 2).over(w) == F.lag("far", 1).over(w)) & (F.lag("n", 1).over(w) == F.col("n") - 1)
    turned = windows.withColumn("_was", F.lag("far", 1).over(w)).withColumn("_steady", steady).where(F.col("_steady") & (F.col("_was") != F.col("far")))
    a = turned.select(*keys, "n", "start_ms", F.col("near").alias("near_a"), F.col("_was").alias("a"), F.col("far").alias("b"))
    b = turned.select(*keys, "n", F.col("near").alias("near_b"), F.col("_was").alias("b"), F.col("far").alias("a"))
    both = a.join(b, [*keys, "n", "a", "b"]).where("near_a < near_b")
    most = overlaps.groupBy(*keys, "n", "view", "a", "b").agg(F.max("overlap").alias("overlap")).withColumn("n", F.explode(F.array("n", F.col("n") + 1))).groupBy(*keys, "n", "view", "a", "b").agg(F.max("overlap").alias("overlap"))
    pick = lambda view, x, y, name: most.where(F.col("view") == view).select(*keys, "n", F.col("a").alias(f"_{x}"), F.col("b").alias(f"_{y}"), F.col("overlap").alias(name))
    both = both.withColumn("_lo", F.least("a", "b")).withColumn("_hi", F.greatest("a", "b")).withColumn("_na", F.col("near_a")).withColumn("_nb", F.col("near_b"))
    got = both.join(pick("far", "lo", "hi", "far_overlap"), [*keys, "n", "_lo", "_hi"], "left").join(pick("near", "na", "nb", "near_overlap"), [*keys, "n", "_na", "_nb"], "left")
    return got.where((F.coalesce("far_overlap", F.lit(0.0)) >= least) & (F.coalesce("near_overlap", F.lit(0.0)) < least)).select(*keys, F.col("start_ms").alias("since"), F.col("_lo").alias("a"), F.col("_hi").alias("b"), "near_a", "near_b")


def merge_ledgers(rows: DataFrame, roots: DataFrame, person: str) -> DataFrame:
    """Ledgers of merged ids as one: sums of counts and payments, first seen, state of the last seen, earliest hold."""
    d = rows.join(roots.select(F.col("id").alias(person), "root"), person, "left").withColumn("root", F.coalesce("root", F.col(person)))
    return d.groupBy("root").agg(F.sum("taken").alias("taken"), F.sum("paid").alias("paid"), F.min("first_ms").alias("first_ms"), F.max_by("state", F.struct("last_ms", person)).alias("state"), F.min("hold_ms").alias("hold_ms"), F.count(F.lit(1)).alias("members"))


def fit_homography(pairs: np.ndarray) -> np.ndarray:
    """Nine row-major coefficients from rows (x, y, u, v), by normalised direct linear transformation."""
    if len(pairs) < 4:
        raise ValueError("four points are needed")

    def scaled(p):
        c = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    src, dst = pairs[:, :2], pairs[:, 2:]
    a, b = scaled(src), scaled(dst)
    one = np.ones((len(pairs), 1))
    p, q = (np.hstack([src, one]) @ a.T), (np.hstack([dst, one]) @ b.T)
    zero = np.zeros_like(p)
    rows = np.vstack([np.hstack([-p, zero, q[:, :1] * p]), np.hstack([zero, -p, q[:, 1:2] * p])])
    _, values, vt = np.linalg.svd(np.linalg.qr(rows, mode="r"))  # nine rows at most, with the singular values and directions of all
    if len(values) > 7 and values[7] < 1e-9:
        raise ValueError("the points are degenerate")
    h = np.linalg.inv(b) @ vt[-1].reshape(3, 3) @ a
    return (h / h[2, 2]).ravel()


def fit_homographies(points: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients and mean reprojection error of each camera from calibration points (x, y, u, v); null when degenerate."""

    def run(pdf):
        p = pdf[["x", "y", "u", "v"]].to_numpy(float)
        try:
            h = fit_homography(p)
        except ValueError:
            return [(None, None, len(p))]
        m = np.hstack([p[:, :2], np.ones((len(p), 1))]) @ h.reshape(3, 3).T
        error = np.sqrt(((m[:, :2] / m[:, 2:] - p[:, 2:]) ** 2).sum(1)).mean()
        return [([float(v) for v in h], float(error), len(p))]

    return grouped(points.select(*keys, "x", "y", "u", "v"), keys, run, "h array<double>, error double, points long")


def usable(box_height: Column, least: Column, score: Column, least_score: float, edges: Column) -> Column:
    """Whether a sample may teach an identity: tall enough, confident, and not cut by the picture's edge."""
    return (box_height >= least) & (score >= least_score) & ~edges


def last_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
