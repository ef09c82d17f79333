"""Unrolling counted copies back into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.keys import col

_COPIES_PER_CHUNK = 10_000


def unroll_copies(df: DataFrame, count: str, number: str, spread_by: Sequence[str]) -> DataFrame:
    """One row per copy with its 1-based ``number``; ``count`` is dropped.

    A row first becomes one row per chunk of copies, and the chunks are dealt out by
    ``spread_by`` and chunk before they are unrolled, so no task unrolls all copies of a row.
    """
    names = [c for c in df.columns if c != count]
    last_chunk = F.expr(f"(`{count}` - 1) div {_COPIES_PER_CHUNK}")
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    dealt = chunks.repartition(*[col(c) for c in spread_by], "_chunk")
    low = F.col("_chunk") * _COPIES_PER_CHUNK + 1
    high = F.least(col(count), (F.col("_chunk") + 1) * _COPIES_PER_CHUNK)
    return dealt.select(*[col(c) for c in names], F.explode(F.sequence(low, high)).alias(number))
