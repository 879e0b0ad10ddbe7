"""The queries of all operators, and the SQL of those that SQL can express."""

from importlib import import_module

_MODULES = ("quality", "pii", "secrets", "token_counts", "katz", "exact_dedup", "byte_bpe", "jaccard_forest", "decontaminate", "toxicity", "filter_audit", "simhash", "merkle")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f".queries.{_name}", __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
