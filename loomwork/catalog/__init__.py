"""All registered queries; importing this package fills the registry."""

import importlib
import pathlib

from loomwork.catalog.registry import ORACLE, QUERIES, Tables, query

PARTS = ("sources", "select", "joins", "aggregates", "windows", "ordering", "changes", "text",
         "dates", "maths", "collections", "structured", "quality", "graph", "jobs", "delays",
         "streams", "surface", "advanced")
for _part in PARTS:
    if (pathlib.Path(__file__).parent / f"{_part}.py").exists():
        importlib.import_module(f"loomwork.catalog.{_part}")

__all__ = ["ORACLE", "QUERIES", "Tables", "query"]
