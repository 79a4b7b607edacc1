"""op13: every conversation damaged by its crc32, then repaired. No SQL form; tests hold it to exhaustive search."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .repair import damage, digests, repair


def op13_repair(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, repaired = repair(damage(rows))
    shas = digests(repaired).select(F.col("conv_id").alias("c"), F.col("sha256").alias("repaired_sha256"))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    whole = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(shas, F.col("id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


QUERIES = {"op13_repair": op13_repair}
ORACLES: dict[str, str] = {}
