"""Delimited text whose quoted fields hold line ends, read in byte ranges.

Spark's own multi-line reader gives every file to one task. Here Spark reads lines in byte ranges, as many tasks as a file
has ranges; whether a line begins a record is known from the parity of the quotes before it: inside a range by a running
sum, across ranges by a prefix sum over one row per range.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.session import broadcast_if_small, durable

_BEFORE = (Window.unboundedPreceding, -1)


def _odd_quotes(line: Column, quote: str, escape: str) -> Column:
    """Whether the line turns inside into outside or back; escaped quotes don't count."""
    if escape and escape != quote:
        line = F.replace(F.replace(line, F.lit(escape * 2), F.lit("")), F.lit(escape + quote), F.lit(""))
    return (F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))) % 2


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per byte range: whether a record is open at its start and end, and the range in which that one began."""
    seen = lines.groupBy("_file", "_range").agg(
        (F.sum("_odd") % 2).alias("_turns"), F.min(F.when(F.col("_odd") == 1, F.col("_line"))).alias("_turn"),
        F.min("_line").alias("_low"), F.max("_line").alias("_high"))
    in_file = Window.partitionBy("_file").orderBy("_range")
    opened = seen.withColumn("_open", F.coalesce(F.sum("_turns").over(in_file.rowsBetween(*_BEFORE)), F.lit(0)) % 2)
    # With a record open, the next one begins behind the line that closes it, if there is one.
    begins = (F.col("_open") == 0) | (F.col("_turn") < F.col("_high"))
    owner = F.last(F.when(begins, F.col("_range")), ignorenulls=True).over(in_file.rowsBetween(*_BEFORE))
    return opened.select(
        F.col("_file").alias("_f"), F.col("_range").alias("_r"), "_low", "_open", owner.alias("_owner"))


def quoted_records(spark: SparkSession, path: str, quote: str = '"', escape: str = "\\") -> DataFrame:
    """``_record, _is_first`` and the partition columns: each record's text, line ends inside quotes kept, and whether it opens its file.

    Quotes must enclose fields or be doubled or escaped inside them. Lines travel once, to the task of their range; only the
    pieces of records that reach over a range's end are shuffled again. Empty lines outside quotes are no records.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    kept = [c for c in text.columns if c != "value"]
    lines = text.select(
        *[F.col(f"`{c}`") for c in kept], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("_text"), _odd_quotes(F.col("value"), quote, escape).alias("_odd"))
    ranges = durable(_ranges(lines))
    placed = lines.join(broadcast_if_small(ranges), (F.col("_file") == F.col("_f")) & (F.col("_range") == F.col("_r")))
    in_range = Window.partitionBy("_file", "_range").orderBy("_line")
    inside = (F.col("_open") + F.coalesce(F.sum("_odd").over(in_range.rowsBetween(*_BEFORE)), F.lit(0))) % 2
    numbered = placed.withColumn("_begins", (inside == 0).cast("int")).withColumn("_number", F.sum("_begins").over(in_range))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_text"))), lambda p: p["_text"]), "\n")
    pieces = numbered.groupBy("_file", "_range", "_number").agg(
        whole.alias("_record"), (F.sum("_odd") % 2).alias("_turned"), F.min("_line").alias("_first_line"),
        *[F.any_value(c).alias(c) for c in ("_low", "_owner")], *[F.any_value(F.col(f"`{c}`")).alias(c) for c in kept])
    first = (F.col("_range") == 0) & (F.col("_first_line") == F.col("_low")) & (F.col("_number") == 1)
    pieces = pieces.withColumn("_is_first", first)
    # A record of this range stays open if its quotes don't pair; what comes first in a range may belong to one before. Both
    # branches below read the same columns, so that Spark shuffles the lines once for both.
    crossing = ((F.col("_number") == 0) & F.col("_owner").isNotNull()) | (F.col("_turned") == 1)
    names = ["_record", "_is_first", *kept]
    complete = pieces.filter(~crossing)
    came = F.when(F.col("_number") == 0, F.col("_owner")).otherwise(F.col("_range"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "_record"))), lambda p: p["_record"]), "\n")
    across = pieces.filter(crossing).groupBy("_file", came.alias("_came")).agg(
        joined.alias("_record"), F.max("_is_first").alias("_is_first"), *[F.any_value(F.col(f"`{c}`")).alias(c) for c in kept])
    both = complete.select(*[F.col(f"`{c}`") for c in names]).unionByName(across.select(*[F.col(f"`{c}`") for c in names]))
    return both.withColumn("_record", F.regexp_replace("_record", "\r$", "")).filter("_record <> ''")


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, options: Mapping[str, Any], header: bool) -> DataFrame:
    """The records parsed by ``schema``, whose last columns may be partition columns; each file's first record is dropped as its header."""
    records = quoted_records(spark, path, options.get("quote", '"'), options.get("escape", "\\"))
    if header:
        records = records.filter(~F.col("_is_first"))
    kept = [c for c in records.columns if c not in ("_record", "_is_first")]
    own = T.StructType([f for f in schema.fields if f.name not in kept])
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    row = F.from_csv("_record", ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.fields), given)
    parsed = records.select(row.alias("_row"), *[F.col(f"`{c}`") for c in kept])
    return parsed.select("_row.*", *[F.col(f"`{c}`") for c in kept])
