"""Operators for large text corpora used as training data.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries where it exists.
"""

from __future__ import annotations

import importlib

_MODULES = ["sharding", "decontaminate", "chat_format", "jaccard_join", "byte_bpe", "quality", "toxicity", "pii", "language_model", "embedding_dedup", "manifest", "vector_codes", "html_extract"]


def all_queries() -> dict:
    from shelfspark.llm.registry import QUERIES

    for m in _MODULES:
        importlib.import_module(f"shelfspark.llm.{m}")
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from shelfspark.llm.registry import SQL_TWINS

    all_queries()
    return dict(SQL_TWINS)
