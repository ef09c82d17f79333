"""Sinks: delimited text, JDBC, and report tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallymark.sources.readers import jdbc_options


def write_mode(append: bool) -> str:
    return "append" if append else "overwrite"


def write_delimited(
    df: DataFrame, path: str, delimiter: str = ",", header: bool = True, append: bool = False, options: Mapping[str, Any] | None = None
) -> int:
    """Write delimited text and return the row count, observed while writing."""
    observed = Observation()
    counted = df.observe(observed, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode(write_mode(append)).option("header", header).option("delimiter", delimiter)
    writer.options(**dict(options or {})).csv(path)
    return observed.get["rows"]


def write_jdbc(df: DataFrame, append: bool = True, **connection: Any) -> None:
    """Needs the driver on the class path; appends unless told otherwise."""
    df.write.format("jdbc").options(**jdbc_options(**connection)).mode(write_mode(append)).save()


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", append: bool = False) -> None:
    """Write each result table below ``path`` as Parquet or JSON."""
    if fmt not in ("parquet", "json"):
        raise ValueError("report format must be parquet or json")
    for name, table in tables.items():
        table.write.mode(write_mode(append)).format(fmt).save(f"{path.rstrip('/')}/{name}")
