"""One query per operator, each over the whole given tables, with its DuckDB text where one exists."""

from __future__ import annotations

from importlib import import_module

from stayframe.queries.registry import ORACLES, QUERIES

for _name in ("tables", "expressions", "aggregates", "versions", "features", "preparation", "models", "logs"):
    import_module(f"stayframe.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
