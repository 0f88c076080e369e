"""End-to-end plans, and the library bound to the given tables."""

from __future__ import annotations

import importlib

from shelfspark.plans.registry import QUERIES, SQL_TWINS

_MODULES = [
    "scalars",
    "catalogue_queries",
    "paper_queries",
    "job_queries",
    "search_queries",
    "source_queries",
    "stream_queries",
]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"shelfspark.plans.{m}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL_TWINS)


def flagship(spark, sf_dir):
    _load()
    return QUERIES["catalogue_flow"](spark, sf_dir)
