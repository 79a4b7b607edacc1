"""All queries of the library and their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES: list[str] = ["windows", "joins", "geometry", "scoring", "state", "datasets", "matching", "streams", "reports", "shelf", "exits", "chains", "sync", "evaluate"]


def _modules():
    return [importlib.import_module(f"storeflow.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
