"""Schema comparison and conforming a DataFrame to a schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.keys import col

_TABLE = "column_name string, source_type string, target_type string, status string"
MISSING = "MISSING"


def _statuses(source: T.StructType, target: T.StructType) -> list[tuple[str, str, str, str]]:
    rows = []
    for name in sorted({*source.names, *target.names}):
        left = source[name].dataType if name in source.names else None
        right = target[name].dataType if name in target.names else None
        if right is None:
            status = "missing_in_target"
        elif left is None:
            status = "missing_in_source"
        else:
            status = "match" if left == right else "type_mismatch"
        rows.append((
            name,
            left.simpleString() if left else MISSING,
            right.simpleString() if right else MISSING,
            status,
        ))
    return rows


def schemas_match(source: DataFrame, target: DataFrame) -> bool:
    """Same column names and exact types; order and top-level nullability do not count."""
    return all(row[3] == "match" for row in _statuses(source.schema, target.schema))


def schema_table(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every column of either side, sorted, with both types and a status."""
    return source.sparkSession.createDataFrame(_statuses(source.schema, target.schema), _TABLE)


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns missing on a side or typed differently."""
    return schema_table(source, target).filter("status <> 'match'")


def schema_issue_counts(source: DataFrame, target: DataFrame) -> dict[str, int]:
    counts = {"missing_in_target": 0, "missing_in_source": 0, "type_mismatch": 0}
    for *_, status in _statuses(source.schema, target.schema):
        if status in counts:
            counts[status] += 1
    return counts


def common_columns(source: DataFrame, target: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns on both sides, in source order, without ``exclude`` (usually the keys)."""
    return [c for c in source.columns if c in target.columns and c not in exclude]


def add_missing_columns(df: DataFrame, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """Append typed null columns for the ``(name, type)`` pairs that are not there yet."""
    new = {n: F.lit(None).cast(t) for n, t in columns if n not in df.columns}
    return df.withColumns(new) if new else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order: missing ones null, present ones cast."""
    return df.select(*[
        (col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def union_evolving(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append rows of a newer schema: columns missing on either side become null."""
    return existing.unionByName(incoming, allowMissingColumns=True)
