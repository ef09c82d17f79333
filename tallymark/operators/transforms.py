"""Row and column transforms. All are ``DataFrame -> DataFrame`` and work on streams too,
except the two that aggregate (:func:`filter_counts`, :func:`group_aggregate`)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.keys import col
from tallymark.operators.schema import common_columns
from tallymark.session import broadcast_if_small


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename ``{old: new}``; names that are not there are skipped."""
    return df.withColumnsRenamed(dict(names))


def _equal(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c == v


def _unequal(c: Column, v: Any) -> Column:
    return c.isNotNull() if v is None else c != v


_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "==": _equal,
    "!=": _unequal,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v),
    "not in": lambda c, v: ~c.isin(v),
    "contains": lambda c, v: c.contains(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
}


def build_predicate(df: DataFrame, conditions: Sequence[Mapping[str, Any]], join_type: str = "and") -> Column | None:
    """One predicate from ``{column, operator, value}`` conditions, or ``None`` without a usable one.

    Conditions on unknown columns, with unknown operators, or ``in`` without a list are left out.
    """
    parts = []
    for condition in conditions:
        name, operator, value = (condition.get(k) for k in ("column", "operator", "value"))
        if not name or name not in df.columns or operator not in _OPERATORS:
            continue
        if operator in ("in", "not in") and not isinstance(value, list):
            continue
        parts.append(_OPERATORS[operator](col(name), value))
    if not parts:
        return None
    every = join_type.lower() == "and"
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)


def filter_rows(df: DataFrame, conditions: Sequence[Mapping[str, Any]], join_type: str = "and") -> DataFrame:
    """Keep the rows that meet the conditions; without a usable condition, all rows."""
    predicate = build_predicate(df, conditions, join_type)
    return df if predicate is None else df.filter(predicate)


def filter_counts(df: DataFrame, conditions: Sequence[Mapping[str, Any]], join_type: str = "and") -> DataFrame:
    """Rows before, after and removed by :func:`filter_rows`, from one pass."""
    predicate = build_predicate(df, conditions, join_type)
    kept = F.count_if(predicate) if predicate is not None else F.count("*")
    counts = df.agg(F.count("*").alias("records_before"), kept.alias("records_after"))
    removed = F.col("records_before") - F.col("records_after")
    return counts.withColumn("records_filtered", removed)


_CASTS = ("string", "int", "double", "float", "boolean", "date", "timestamp")


def cast_columns(
    df: DataFrame,
    types: Mapping[str, str],
    date_format: str = "yyyy-MM-dd",
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """Cast ``{column: type}``; a value that cannot be cast becomes null.

    Dates and timestamps are read from text by the given formats. Absent columns and unknown
    type names are skipped.
    """
    changed = {}
    for name, wanted in types.items():
        kind = wanted.lower()
        if name not in df.columns or kind not in _CASTS:
            continue
        dtype = df.schema[name].dataType
        if dtype.simpleString() == kind:
            continue
        if kind == "date" and isinstance(dtype, T.StringType):
            changed[name] = F.to_date(F.try_to_timestamp(col(name), F.lit(date_format)))
        elif kind == "timestamp" and isinstance(dtype, T.StringType):
            changed[name] = F.try_to_timestamp(col(name), F.lit(timestamp_format))
        else:
            changed[name] = col(name).try_cast(kind)
    return df.withColumns(changed) if changed else df


def align_types(source: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with every shared column cast to exactly the source's type."""
    changed = {
        name: col(name).try_cast(source.schema[name].dataType)
        for name in common_columns(source, target)
        if source.schema[name].dataType != target.schema[name].dataType
    }
    return target.withColumns(changed) if changed else target


def array_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def explode_arrays(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per array element; an empty or null array keeps its row with a null.

    Two or more arrays multiply rows, so they have to be named by the caller.
    """
    arrays = array_columns(df)
    if columns is None:
        if len(arrays) > 1:
            raise ValueError(f"several array columns, name those to explode: {arrays}")
        columns = arrays
    for name in columns:
        df = df.select(*[F.explode_outer(col(c)).alias(c) if c == name else col(c) for c in df.columns])
    return df


def flatten_structs(df: DataFrame, separator: str = "_") -> DataFrame:
    """Expand struct columns to ``parent<separator>child``, at every depth."""

    def leaves(column: Column, name: str, dtype: T.DataType) -> list[Column]:
        if not isinstance(dtype, T.StructType):
            return [column.alias(name)]
        return [
            leaf
            for f in dtype.fields
            for leaf in leaves(column.getField(f.name), f"{name}{separator}{f.name}", f.dataType)
        ]

    return df.select(*[leaf for f in df.schema.fields for leaf in leaves(col(f.name), f.name, f.dataType)])


def decode_codes(
    df: DataFrame, codes: DataFrame, column: str, order_by: Column | None = None
) -> DataFrame:
    """Add ``<column>_decoded`` from a two-column code list; unknown codes give null.

    Of repeated codes the last counts: by ``order_by`` where given, else the largest text. The
    code list is broadcast only after its size was measured.
    """
    code, text = codes.columns[0], codes.columns[1]
    order = order_by if order_by is not None else col(text)
    listed = (
        codes.filter(col(code).isNotNull())
        .groupBy(col(code).cast("string").alias("_code"))
        .agg(F.max_by(col(text), order).alias("_text"))
    )
    lookup = broadcast_if_small(listed) if not df.isStreaming else listed
    joined = df.join(lookup, col(column).cast("string") == F.col("_code"), "left_outer")
    decoded = F.when(F.col("_text").cast("string") != "", F.col("_text"))
    return joined.select(*[df[f"`{c}`"] for c in df.columns], decoded.alias(f"{column}_decoded"))


def add_constant(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def keep_value(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows whose column equals a parameter."""
    return df.filter(_equal(col(column), value))


def upper_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.upper(col(column)))


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
}


def group_aggregate(df: DataFrame, column: str, function: str, group_by: Sequence[str]) -> DataFrame:
    """``function`` of ``column`` per group, as ``<function>_<column>``."""
    if function not in _AGGREGATES:
        raise ValueError(f"aggregation function must be one of {sorted(_AGGREGATES)}")
    return df.groupBy(*[col(g) for g in group_by]).agg(_AGGREGATES[function](col(column)).alias(f"{function}_{column}"))
