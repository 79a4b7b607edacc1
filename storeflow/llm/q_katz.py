"""op11: a language-model score for every document. No SQL form; tests hold it to a plain Katz model."""

from __future__ import annotations

from pyspark.sql import functions as F

from .katz import score


def op11_katz(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score(docs, ~held).select("doc_id", (~F.col("teach")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op11_katz": op11_katz}
ORACLES: dict[str, str] = {}
