"""op1: SimHash of every document and of its edited text. xxhash64 has no SQL twin in the oracle; tests use brute force."""

from __future__ import annotations

from .fingerprints import fingerprint_edits


def op1_fingerprints(spark, sf_dir):
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}
