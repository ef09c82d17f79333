"""Positional and multi-record layouts over text lines and fixed-length binary records."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELD_TYPES = {"int": "int", "double": "double", "date": "date"}


def fixed_length(lines: DataFrame, fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``{name: (start, length)}``, from 1, values as they stand."""
    return lines.select(*[F.substring("value", start, length).alias(n) for n, (start, length) in fields.items()])


def fixed_width(lines: DataFrame, fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``{name: (start, end)}``, from 1, the end included, values as they stand."""
    return lines.select(*[F.substring("value", start, end - start + 1).alias(n) for n, (start, end) in fields.items()])


def field_value(field: Mapping[str, Any], line: Column) -> Column:
    """A trimmed and typed field ``{name, start, length, type?}``, from 0.

    Past the end of the line the text is empty. What cannot be cast is null.
    """
    text = F.regexp_replace(F.substring(line, field.get("start", 0) + 1, field.get("length", 0)), r"(?U)^\s+|\s+$", "")
    kind = str(field.get("type", "string")).lower()
    value = text.try_cast(_FIELD_TYPES[kind]) if kind in _FIELD_TYPES else text
    return value.alias(field["name"])


def typed_fixed_width(lines: DataFrame, fields: Sequence[Mapping[str, Any]]) -> DataFrame:
    return lines.select(*[field_value(f, F.col("value")) for f in fields])


def record_type_fixed_width(
    lines: DataFrame,
    record_types: Mapping[str, Sequence[Mapping[str, Any]]],
    data_record_types: Sequence[str],
    include_record_type: bool = True,
) -> dict[str, DataFrame]:
    """One DataFrame per data record type; lines of other types (headers, trailers) are left out.

    The type is the start of the line. Without ``include_record_type`` the field named
    ``record_type`` is left out.
    """
    tables = {}
    for name in data_record_types:
        fields = [f for f in record_types[name] if include_record_type or f["name"] != "record_type"]
        tables[name] = typed_fixed_width(lines.filter(F.col("value").startswith(name)), fields)
    return tables


def delimited_lines(lines: DataFrame, fields: Sequence[str], separator: str = "|") -> DataFrame:
    """Split each line; a line with fewer parts gives nulls, further parts are dropped."""
    parts = F.split("value", _literal(separator), -1)
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(fields)])


def record_type_delimited(
    lines: DataFrame, record_types: Mapping[str, Sequence[str]], separator: str = "|"
) -> dict[str, DataFrame]:
    """One DataFrame per record type; the type is the first field of a line."""
    parts = F.split("value", _literal(separator), -1)
    return {
        name: lines.filter(F.get(parts, 0) == name).select(
            *[F.get(parts, i + 1).alias(c) for i, c in enumerate(columns)]
        )
        for name, columns in record_types.items()
    }


def _literal(separator: str) -> str:
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# --- EBCDIC records -----------------------------------------------------------------------


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Allow every charset of the JVM, EBCDIC code pages among them, while a plan is built."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def read_binary_records(spark: SparkSession, path: str, record_length: int) -> DataFrame:
    """Fixed-length records as a binary column ``record``; splits fall on record borders and no record leaves the JVM."""
    records = spark.sparkContext._jsc.sc().binaryRecords(path, record_length, spark.sparkContext._jsc.hadoopConfiguration())
    rows = spark._jsparkSession.createDataset(records, spark.sparkContext._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(rows.toDF(), spark).toDF("record")


def decode_records(records: DataFrame, fields: Sequence[Mapping[str, Any]], charset: str = "IBM1047") -> DataFrame:
    """Fields ``{name, start, length, type?, scale?}`` (from 0, in bytes) of a ``record`` column.

    Types: ``text`` (trimmed), ``packed`` (packed decimal), ``zoned`` (one digit per byte, sign
    in the last), ``binary`` (big-endian two's complement, up to 8 bytes).
    """
    with java_charsets(records.sparkSession):
        return records.select(*[_record_field(f, charset).alias(f["name"]) for f in fields])


def _record_field(field: Mapping[str, Any], charset: str) -> Column:
    raw = F.substring(F.col("record"), field["start"] + 1, field["length"])
    kind, scale = field.get("type", "text"), int(field.get("scale", 0))
    if kind == "text":
        return F.trim(F.decode(raw, charset))
    digits = F.hex(raw)
    n = 2 * field["length"]
    if kind == "packed":
        return _signed(F.substring(digits, 1, n - 1), F.substring(digits, n, 1), n - 1, scale)
    if kind == "zoned":
        numbers = F.regexp_replace(digits, "(.)(.)", "$2")
        return _signed(numbers, F.substring(digits, n - 1, 1), field["length"], scale)
    if kind == "binary":
        # Unsigned first; a value in the upper half stands for itself minus the full range.
        unsigned = F.conv(digits, 16, 10).try_cast("decimal(20,0)")
        half, full = (F.lit(str(2 ** (4 * n - k))).cast("decimal(20,0)") for k in (1, 0))
        signed = F.when(unsigned >= half, unsigned - full)
        whole = F.coalesce(signed, unsigned)
        return whole.try_cast("long") if scale == 0 else (whole / F.lit(10**scale)).try_cast(f"decimal(20,{scale})")
    raise ValueError(f"unknown record field type '{kind}'")


def _signed(digits: Column, sign: Column, width: int, scale: int) -> Column:
    """A decimal from digit text and a sign nibble (B and D are negative)."""
    text = digits
    if scale:
        text = F.concat(F.substring(digits, 1, width - scale), F.lit("."), F.substring(digits, width - scale + 1, scale))
    minus = F.when(sign.isin("B", "D"), "-").otherwise("")
    return F.concat(minus, text).try_cast(f"decimal({max(width, scale + 1)},{scale})")
