"""Joins on time and intervals: bucketed range joins, nearest in time, ranked picks, alias chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import pieces, shared_checkpoint


def range_join(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, bucket: int, slack: int = 0, tasks: int | None = None) -> DataFrame:
    """Pairs whose closed intervals, the left widened by `slack`, overlap.

    Each side is dealt to the time buckets it touches and joined on keys and bucket; a pair is kept only in the first
    bucket both touch, so it appears once and needs no distinct. Choose `bucket` near the median length. Give `tasks` where the
    pairs are so many more than the rows that Spark would make too few.
    """
    fl = lambda c: F.floor(c / bucket)
    ls, le = F.col(l_start) - slack, F.col(l_end) + slack
    a = left.withColumn("__lf", fl(ls)).withColumn("__bucket", F.explode(F.sequence(F.col("__lf"), F.greatest(F.col("__lf"), fl(le)))))
    b = right.withColumn("__rf", fl(F.col(r_start))).withColumn("__bucket", F.explode(F.sequence(F.col("__rf"), F.greatest(F.col("__rf"), fl(F.col(r_end))))))
    a = a if tasks is None else a.repartition(tasks, *keys, "__bucket")
    j = a.join(b, [*keys, "__bucket"])
    return j.where((F.col("__bucket") == F.greatest("__lf", "__rf")) & (ls <= F.col(r_end)) & (le >= F.col(r_start))).drop("__bucket", "__lf", "__rf")


def listed(rows: DataFrame, keys: list[str], ident: str, most: int) -> DataFrame:
    """(keys, `ident`s): the ids of equal keys as lists of at most `most`; null ids are left out. About 262,144 ids are gathered at once, however many share a key."""
    own = rows.groupBy(*keys, F.pmod(F.xxhash64(ident), F.lit(pieces(rows, least=1)))).agg(F.collect_list(ident).alias("_ids"))
    cut = F.transform(F.sequence(F.lit(1), F.size("_ids"), F.lit(most)), lambda i: F.slice("_ids", i, most))
    return own.where(F.size("_ids") > 0).select(*keys, F.explode(cut).alias(f"{ident}s"))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, tie: str, value: str, tolerance: int) -> DataFrame:
    """For each left row the right value nearest in time within the tolerance (ties: the earlier), without a join.

    Both sides are unioned and the last and, in falling order, the next right sample are carried over each row: two sorts per
    key, as a frame that ends at the last row would be gone through anew for every row.
    """
    point = F.struct(F.col(time).alias("t"), F.col(tie).alias("k"), F.col(value).alias("v"))
    none = F.lit(None)
    l = left.select(*keys, F.col(time).alias("_t"), F.col(tie).alias("_k"), F.lit(1).alias("_side"), none.cast(right.select(point).schema[0].dataType).alias("_p"))  # noqa: E741
    r = right.select(*keys, F.col(time).alias("_t"), F.col(tie).alias("_k"), F.lit(0).alias("_side"), point.alias("_p"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_k")
    u = l.unionByName(r)
    u = u.withColumn("_a", F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    falling = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_z", F.last("_p", ignorenulls=True).over(falling)).where("_side = 1")
    da, dz = F.col("_t") - F.col("_a.t"), F.col("_z.t") - F.col("_t")
    pick = F.when(F.col("_z").isNull() | (da <= dz), F.col("_a")).otherwise(F.col("_z"))
    near = u.withColumn("_n", pick).withColumn("_d", F.abs(F.col("_n.t") - F.col("_t")))
    ok = F.col("_d") <= tolerance
    return near.select(*keys, F.col("_t").alias(time), F.col("_k").alias(tie), F.when(ok, F.col("_n.v")).alias(f"near_{value}"), F.when(ok, F.col("_d")).alias("dt_ms"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """The last right value at or before each left row's time."""
    l = left.select(*keys, F.col(time).alias("_t"), F.col(tie).alias("_k"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))  # noqa: E741
    r = right.select(*keys, F.col(time).alias("_t"), F.col(tie).alias("_k"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn("_a", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*keys, F.col("_t").alias(time), F.col("_k").alias(tie), F.col("_a").alias(f"last_{value}"))


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def concurrent_pairs(obs: DataFrame, frame: list[str], ident: str, score: Column, least: float) -> DataFrame:
    """Pairs a < b in one frame whose score (over columns a_*, b_*) is at least `least`. A frame holds few objects."""
    cols = [c for c in obs.columns if c not in frame]
    a = obs.select(*frame, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = obs.select(*frame, *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, frame).where(F.col(f"a_{ident}") < F.col(f"b_{ident}")).withColumn("score", score).where(F.col("score") >= least)


def resolve_aliases(nodes: DataFrame, merges: DataFrame, ident: str = "id", rounds: int = 40) -> DataFrame:
    """Root of each id along from -> into edges (each `from` once), by pointer jumping: as many joins as the log of the longest chain."""
    ids = nodes.select(F.col(ident)).union(merges.select("into")).union(merges.select(F.col("from"))).distinct()
    p = ids.join(merges.select(F.col("from").alias(ident), F.col("into").alias("root")), ident, "left").withColumn("root", F.coalesce("root", F.col(ident)))
    p = shared_checkpoint(p)
    for _ in range(rounds):
        up = p.select(F.col(ident).alias("root"), F.col("root").alias("next"))
        q = p.join(up, "root").select(ident, F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        q = shared_checkpoint(q)
        p = q.select(ident, "root")
        if q.where("moved").isEmpty():
            break
    return p


def full_compare(base: DataFrame, new: DataFrame, keys: list[str], value: str, rank: Column | None = None) -> DataFrame:
    """Full outer comparison: missing, extra, same, better or worse."""
    a, b = base.select(*keys, F.col(value).alias("old")), new.select(*keys, F.col(value).alias("new"))
    j = a.join(b, keys, "full")
    return j.withColumn("change", F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra").when(F.col("new") > F.col("old"), "better").when(F.col("new") < F.col("old"), "worse").otherwise("same"))


def with_fallback(codes: DataFrame, code: str, products: DataFrame, barcode: str) -> DataFrame:
    """First product found under the code, the code with a leading zero (12 digits), or without one (13 digits)."""
    c = F.col(code)
    cand = F.array_compact(F.array(c, F.when(F.length(c) == 12, F.concat(F.lit("0"), c)), F.when((F.length(c) == 13) & c.startswith("0"), F.substring(c, 2, 12))))
    e = codes.select("*", F.posexplode(cand).alias("_prio", "_code")).join(products.withColumnRenamed(barcode, "_code"), "_code")
    return top_one(e, [code], [F.col("_prio")]).drop("_prio").withColumnRenamed("_code", "matched_code")
