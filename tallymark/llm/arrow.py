"""Rows through Arrow: small helpers shared by the operators that work on whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ROWS = 1024
_BYTES = 1 << 20


def text_columns(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty; nothing else of ``df`` survives, so names cannot clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *more,
    )


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many more underscores in front as it takes to differ from the columns of ``df`` in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def row_blocks(batches: Iterable[pa.RecordBatch], size: int = _BYTES) -> Iterator[list[tuple]]:
    """Rows as tuples in blocks of at most 1,024 rows and, unless one row is larger, ``size`` bytes, so that few texts are held twice."""
    for batch in batches:
        step = max(1, min(_ROWS, size * batch.num_rows // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
            yield list(zip(*columns, strict=True))


def map_blocks(df: DataFrame, block: Callable[[list[tuple]], Sequence[Sequence]], schema: str, done: Callable[[], None] | None = None,
               size: int = _BYTES) -> DataFrame:
    """The rows that ``block`` makes of blocks of rows, through Arrow. ``done`` is called at the end of each task."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(kind)
        for rows in row_blocks(batches, size):
            yield rows_to_batch(block(rows), kinds)
        if done is not None:
            done()

    return df.mapInArrow(run, kind)


def rows_to_batch(rows: Sequence[Sequence], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)
