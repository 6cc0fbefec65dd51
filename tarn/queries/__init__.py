"""Named queries: each module holds QUERIES (name -> (spark, sf_dir) -> DataFrame) and ORACLES (name -> SQL)."""

from __future__ import annotations

import importlib

MODULES = ("wide", "texts", "search", "pages", "rest", "more")


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tarn.queries.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
