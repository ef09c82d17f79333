"""The queries of the driver contract, one module per area.

Each module holds ``QUERIES``: name -> (callable(spark, sf_dir), oracle SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_AREAS = ("compare", "quality", "transform", "attribution", "outcomes", "logs", "formats")


def all_queries() -> dict[str, tuple[Query, str | None]]:
    merged: dict[str, tuple[Query, str | None]] = {}
    for area in _AREAS:
        for name, entry in import_module(f"{__name__}.{area}").QUERIES.items():
            if name in merged:
                raise ValueError(f"query '{name}' is registered twice")
            merged[name] = entry
    return merged
