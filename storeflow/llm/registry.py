"""Queries of the text-corpus operators and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ["q_decontaminate", "q_toxicity", "q_jaccard", "q_licenses", "q_packing", "q_urlfilter", "q_chat", "q_tokencount", "q_warc", "q_fingerprints", "q_katz", "q_hardneg", "q_repair"]


def _modules():
    return [importlib.import_module(f"storeflow.llm.{m}") for m in MODULES]


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
