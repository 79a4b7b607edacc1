"""op9: licence phrases and notices in every document. The method's labels have no SQL form; tests use brute force."""

from __future__ import annotations

from .licenses import scan


def op9_licenses(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
