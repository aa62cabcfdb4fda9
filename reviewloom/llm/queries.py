"""All queries of this package; importing it fills the registry."""

from __future__ import annotations

from importlib import import_module

from reviewloom.llm.common import QUERIES, SQL

MODULES = ["exact_dedup", "sharding", "mixing", "secrets", "toxicity", "quality", "ngram_join", "decontaminate", "url_filter",
           "chat", "collocations", "turn_repair",
           "vector_search"]

for _name in MODULES:
    import_module(f"reviewloom.llm.{_name}")

__all__ = ["QUERIES", "SQL"]
