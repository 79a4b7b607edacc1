"""op7: components of documents whose 5-word shingle sets are 0.8 alike. SQL is too slow on whole tables; tests use brute force."""

from __future__ import annotations

from .jaccard import near_duplicates


def op7_jaccard(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLES: dict[str, str] = {}
