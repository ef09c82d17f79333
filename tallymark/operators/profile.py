"""Count, null and duplicate profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.keys import col, group_columns, key_overlap


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def count_validation(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows per side, whether they match, and their absolute difference."""
    tagged = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(
        target.select(F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    counts = tagged.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_count"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("target_count"),
    )
    return counts.select(
        "source_count",
        "target_count",
        (F.col("source_count") == F.col("target_count")).alias("count_match"),
        F.abs(F.col("source_count") - F.col("target_count")).alias("count_difference"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count, row count and null percentage per column, from one aggregate."""
    names = list(columns or df.columns)
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(col(n).isNull()).alias(f"nulls_{i}") for i, n in enumerate(names)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.col(f"nulls_{i}").alias("null_count"))
            for i, n in enumerate(names)
        ]
    )
    return counts.select("rows", F.inline(entries)).select(
        "column_name",
        "null_count",
        F.col("rows").alias("total_count"),
        percent(F.col("null_count"), F.col("rows")).alias("null_percentage"),
    )


def duplicate_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys (a null counts as a value), and rows beyond the first per key."""
    per_key = df.select(*group_columns(df, keys)).groupBy(*[col(k) for k in keys]).count()
    totals = per_key.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_records"),
        F.count("*").alias("unique_records"),
    )
    return _with_duplicates(totals)


def _with_duplicates(totals: DataFrame) -> DataFrame:
    duplicates = F.col("total_records") - F.col("unique_records")
    return totals.select(
        "total_records",
        "unique_records",
        duplicates.alias("duplicate_count"),
        percent(duplicates, F.col("total_records")).alias("duplicate_percentage"),
    )


def overlap_summary(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of totals from one shuffle over the keys alone.

    ``matching_records`` counts source rows whose key is in the target; ``source_only`` and
    ``target_only`` count distinct keys; the ``*_unique`` columns count distinct keys per side.
    """
    source_rows, target_rows = F.col("source_rows"), F.col("target_rows")

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return key_overlap(source, target, keys).agg(
        total(source_rows).alias("source_count"),
        total(target_rows).alias("target_count"),
        total(F.when(target_rows > 0, source_rows)).alias("matching_records"),
        F.count_if(target_rows == 0).alias("source_only"),
        F.count_if(source_rows == 0).alias("target_only"),
        F.count_if(source_rows > 0).alias("source_unique"),
        F.count_if(target_rows > 0).alias("target_unique"),
    )
