"""Queries of the training-data operators and of the pipeline, by name."""

from __future__ import annotations

from importlib import import_module

from corpusgraph.llm import pipeline

QUERIES = {}
ORACLE_SQL = {}
for _n in range(1, 11):
    _module = import_module(f"corpusgraph.llm.op{_n}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
QUERIES["pipeline"] = pipeline.run
if pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = pipeline.ORACLE_SQL
