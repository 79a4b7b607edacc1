"""Dataset preparation: leak-free splits, quotas, merges, integrity checks, problem flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import numbered


def draw(seed: int, ident: Column) -> Column:
    """A reproducible random order, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), ident.cast("string")))


def modal_class(rows: DataFrame, group: str, cls: str) -> DataFrame:
    c = rows.groupBy(group, cls).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(group).agg(F.min_by(cls, F.struct(-F.col("_n"), F.col(cls))).alias("cls"))


def drawn(rows: DataFrame, cls: str, ident: str, seed: int) -> DataFrame:
    """Adds _n, the rows of the class, and _k, the place in its random order, without one task a class.

    The order's first three hex digits cut a class into 4096 cells: places within a cell, plus the rows of the cells before.
    """
    d = rows.withColumn("_o", draw(seed, F.col(ident))).withColumn("_cell", F.substring("_o", 1, 3))
    c = d.groupBy(cls, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(cls)
    c = c.select(cls, "_cell", F.sum("_c").over(w).alias("_n"), F.coalesce(F.sum("_c").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    k = F.row_number().over(Window.partitionBy(cls, "_cell").orderBy("_o", ident))
    return d.join(c, [cls, "_cell"]).withColumn("_k", F.col("_before") + k).drop("_o", "_cell", "_before")


def group_split(rows: DataFrame, group: str, cls: str, val: float, test: float = 0.0, seed: int = 1337) -> DataFrame:
    """Split of each group: whole groups go to one side, drawn within their modal class.

    Per class of n groups: with a test share, max(1, round) of them when n >= 3; then max(1, round) to val when two remain.
    """
    g = drawn(modal_class(rows, group, cls), "cls", group, seed)
    size = lambda share: F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("int"))
    n_test = F.when(F.col("_n") >= 3, size(test)).otherwise(0) if test else F.lit(0)
    n_val = F.when(F.col("_n") - n_test >= 2, size(val)).otherwise(0) if test else size(val)
    side = F.when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_val, "val").otherwise("train")
    return g.select(group, "cls", side.alias("split"))


def ordinal_split(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """By position within its kind: every fifth from the third is test, from the fifth val."""
    i = F.col("_i") - 1
    return numbered(rows, [kind], [order], "_i").withColumn("split", F.when(i % 5 == 2, "test").when(i % 5 == 4, "val").otherwise("train")).drop("_i")


def drop_leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups present in train and elsewhere lose their train rows."""
    other = rows.where(F.col(split) != "train").select(group).distinct()
    return rows.where(F.col(split) != "train").unionByName(rows.where(F.col(split) == "train").join(other, group, "left_anti").select(*rows.columns))


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups found on more than one side."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("sides")).where(F.size("sides") > 1)


def quota(rows: DataFrame, cls: str, store: str, take: str, cap: int) -> DataFrame:
    """Whole takes per class, stores in turn, until the cap is reached (the take that reaches it stays)."""
    t = rows.groupBy(cls, store, take).agg(F.count(F.lit(1)).alias("clips"))
    t = t.withColumn("_turn", F.row_number().over(Window.partitionBy(cls, store).orderBy(draw(1337, F.col(take)))))
    t = t.where(F.col("_turn") <= cap)  # as many clips of its own store come before
    w = Window.partitionBy(cls).orderBy("_turn", store, take).rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("before", F.coalesce(F.sum("clips").over(w), F.lit(0))).where(F.col("before") < cap).drop("_turn")


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys in `new` are replaced; others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def protected_merge(old: DataFrame, drafts: DataFrame, key: str, edited: Column, force: bool = False) -> DataFrame:
    """Drafts replace a key unless a person has edited one of its rows."""
    if force:
        return replace_keys(old, drafts, [key])
    kept = old.where(edited).select(key).distinct()
    return replace_keys(old, drafts.join(kept, key, "left_anti").select(*old.columns), [key])


def write_guard(baseline: DataFrame, result: DataFrame, keys: list[str]) -> DataFrame:
    """Reasons to refuse a new baseline: keys that it lacks, or an empty result."""
    gone = baseline.select(*keys).distinct().join(result.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("missing_keys"))
    return gone.join(result.agg(F.count(F.lit(1)).alias("rows")), how="cross").withColumn("allowed", (F.col("missing_keys") == 0) & (F.col("rows") > 0))  # two single rows


def problems(**rules: Column) -> Column:
    """Names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def integrity(manifest: DataFrame, files: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key: ok, missing, extra, or a digest that differs."""
    a, b = manifest.select(key, F.col(digest).alias("want")), files.select(key, F.col(digest).alias("have"))
    return a.join(b, key, "full").select(key, F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed").otherwise("ok").alias("status"))


def weighted_sample(rows: DataFrame, cls: str, ident: str, n: int, seed: int = 1337) -> DataFrame:
    """About n rows with weight 1 / class count: each class has the same expected share; a draw repeats no row."""
    c = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    d = rows.join(c, cls).withColumn("_u", F.conv(F.substring(draw(seed, F.col(ident)), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32)))
    classes = rows.agg(F.count_distinct(cls).alias("_c"))
    return d.join(F.broadcast(classes), how="cross").where(F.col("_u") * F.col("_n") * F.col("_c") < n).drop("_n", "_u", "_c")  # one row


def limited(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
