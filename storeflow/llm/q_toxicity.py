"""op8: a toxicity score for every document. No SQL form; tests hold it to held-out accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from .toxicity import score, train, training_labels


def op8_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, training_labels(labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
