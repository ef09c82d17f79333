"""Run stateless transforms on a stream.

The transforms of :mod:`tallymark.operators.transforms`, the log expressions and the validators
are plain column expressions, so the same functions serve batches and streams. Nothing here keeps
state; a restart continues from the query's own checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tallymark.session import scratch_path


def apply_stateless(stream: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda df, step: df.transform(step), steps, stream)


def write_available(stream: DataFrame, path: str, checkpoint: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Append everything that is there now to ``path`` and stop; files are written exactly once."""
    location = checkpoint or scratch_path(stream.sparkSession, "stream")
    return (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", location)
        .trigger(availableNow=True)
        .start(path)
    )
