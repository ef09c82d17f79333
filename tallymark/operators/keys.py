"""Key discovery, validation and classification, and key-level overlap of two datasets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.compare import cell_text, comparable, exact_forms
from tallymark.session import durable

# Key search: relative error of the distinct counts, and how far a product may lie below the rows before it refutes.
_SKETCH_ERROR = 0.02
_SKETCH_MARGIN = 2
# Rows per column's sample, and the values its range should hold at least. They only refute, so they bound work, not results.
_SAMPLED_ROWS = 20_000
_SAMPLED_VALUES = 64
# Repeating keys and rows that a failed check hands on.
_EVIDENCE_KEYS = 1_000
_EVIDENCE_ROWS = 10_000


def col(name: str) -> Column:
    """A top-level column by its literal name (dots and spaces included)."""
    return F.col(f"`{name}`")


def group_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns in a groupable form, under their own names."""
    return [comparable(col(n), df.schema[n].dataType).alias(n) for n in names]


def has_duplicates(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key value repeats. Partial aggregation keeps a hot key off any single task."""
    counts = df.select(*group_columns(df, keys)).groupBy(*[col(k) for k in keys]).count()
    return bool(counts.filter(F.col("count") > 1).limit(1).count())


def find_key(df: DataFrame, max_columns: int = 3) -> tuple[str, ...] | None:
    """First column, else first combination of up to ``max_columns``, that is unique and not null; of an empty table the first column.

    The search walks the lattice of combinations and reads the table a fixed number of times, however many there are:

    * one pass counts rows, nulls and, by sketches, distinct values; a column with nulls can be in no key, and neither can
      columns whose distinct counts multiply to far less than the rows;
    * one bounded sample per column, of whole groups of equal values, refutes every combination that repeats in it;
    * what is left is checked over all rows, in order. The first that holds is the answer; one that fails leaves
      repeating rows, which refute every other combination they agree on.
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    if not names:
        return None
    values = group_columns(df, names)
    profile = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(values)]).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"_v{i}").isNull()).alias(f"nulls_{i}") for i in range(len(names))],
        *[F.approx_count_distinct(f"_v{i}", _SKETCH_ERROR).alias(f"distinct_{i}") for i in range(len(names))],
    ).first()
    usable = [i for i in range(len(names)) if profile[f"nulls_{i}"] == 0]
    rows, distinct = profile["rows"], [profile[f"distinct_{i}"] for i in usable]
    # A column's code is the hash of its value: equal values have equal codes.
    codes = F.array(*[F.xxhash64(values[i]) for i in usable]).alias("codes")
    sample = None
    for width in range(1, min(max_columns, len(usable)) + 1):
        if not any(_may_be_unique(c, distinct, rows) for c in combinations(range(len(usable)), width)):
            continue
        sample = sample if sample is not None else _anchor_samples(df.select(codes), distinct, rows)
        left = _unrefuted(sample, distinct, rows, width)
        while left:
            chosen = tuple(names[usable[i]] for i in left[0])
            evidence = _repeating_rows(df, codes, chosen)
            if evidence is None:
                return chosen
            left = [c for c in left[1:] if not _repeats(evidence, c)]
    return None


def _may_be_unique(columns: Sequence[int], distinct: Sequence[int], rows: int) -> bool:
    """Whether the product of the distinct counts reaches the rows, with ample room for the error of the sketches."""
    return prod(distinct[i] for i in columns) * _SKETCH_MARGIN >= rows


def _anchor(columns: Sequence[int], distinct: Sequence[int]) -> int:
    """The column of a combination whose sample decides: the one with most distinct values, whose groups are smallest."""
    return max(columns, key=lambda i: (distinct[i], i))


def _anchor_samples(codes: DataFrame, distinct: Sequence[int], rows: int) -> DataFrame:
    """``anchor, codes, copies``: about ``_SAMPLED_ROWS`` rows per column, whose values there fall in one range of hashes.

    The ranges are measured first, and thinned by whole rows where a value in them is hot; equal rows are counted, not
    kept, so no sample grows with the table.
    """
    every = range(len(distinct))
    # A column of few values is thinned by rows only, so that its range is not empty.
    parts = [max(1, min(rows // _SAMPLED_ROWS, n // _SAMPLED_VALUES)) for n in distinct]
    in_range = [F.pmod(F.xxhash64(F.get("codes", F.lit(i))), F.lit(n)) == 0 for i, n in enumerate(parts)]
    measured = rows > _SAMPLED_ROWS
    sizes = codes.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(in_range)]).first() if measured else [rows] * len(distinct)
    thin = [max(1, -(-sizes[i] // _SAMPLED_ROWS)) for i in every]
    picked = [
        F.when(in_range[i] & (F.pmod(F.xxhash64("codes", F.lit(i)), F.lit(thin[i])) == 0), F.lit(i)) for i in every
    ]
    rows_of = codes.select("codes", F.explode(F.array_compact(F.array(*picked))).alias("anchor"))
    return durable(rows_of.groupBy("anchor", "codes").agg(F.count("*").alias("copies")))


def _unrefuted(sample: DataFrame, distinct: Sequence[int], rows: int, width: int) -> list[tuple[int, ...]]:
    """The combinations of ``width`` columns, in order, that their anchor's sample does not refute."""

    def survivors(group: pd.DataFrame) -> pd.DataFrame:
        anchor = int(group["anchor"].iloc[0])
        held = group.dropna(subset=["codes"])
        # Of equal rows two are enough to repeat.
        kept = held.loc[held.index.repeat(np.minimum(held["copies"].astype("int64"), 2))]
        values = np.stack(kept["codes"].to_numpy()) if len(kept) else np.empty((0, len(distinct)), dtype="int64")
        lower = [i for i in range(len(distinct)) if _anchor((i, anchor), distinct) == anchor and i != anchor]
        found = [
            sorted((anchor, *others))
            for others in _without_repeats(values, _agreeing(np.zeros(len(values), dtype="int64"), values[:, anchor]), lower, width - 1)
        ]
        return pd.DataFrame({"columns": [c for c in found if _may_be_unique(c, distinct, rows)]}, dtype="object")

    spark = sample.sparkSession
    # One empty row per column, so that a column without a sample keeps its combinations.
    marks = spark.range(len(distinct)).select(F.col("id").cast("int").alias("anchor"))
    groups = sample.unionByName(marks, allowMissingColumns=True).groupBy("anchor")
    left = groups.applyInPandas(survivors, "columns array<int>").collect()
    return sorted(tuple(r["columns"]) for r in left)


def _agreeing(classes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Classes of rows that are in one class and have one value; -1 for a row that is alone."""
    known = np.flatnonzero(classes >= 0)
    order = known[np.lexsort((values[known], classes[known]))]
    out = np.full(len(classes), -1, dtype="int64")
    if not len(order):
        return out
    starts = np.r_[True, (np.diff(classes[order]) != 0) | (values[order][1:] != values[order][:-1])]
    number = np.cumsum(starts) - 1
    out[order] = np.where(np.bincount(number)[number] > 1, number, -1)
    return out


def _without_repeats(values: np.ndarray, classes: np.ndarray, columns: Sequence[int], width: int) -> Iterator[tuple[int, ...]]:
    """Every choice of ``width`` of the columns on which no two rows of one class agree; only rows that still agree go on."""
    rows = np.flatnonzero(classes >= 0)
    if not len(rows):
        yield from combinations(columns, width)
        return
    values, classes = values[rows], classes[rows]
    if width:
        for at, column in enumerate(columns):
            further = _without_repeats(values, _agreeing(classes, values[:, column]), columns[at + 1 :], width - 1)
            yield from ((column, *rest) for rest in further)


def _repeating_rows(df: DataFrame, codes: Column, keys: Sequence[str]) -> np.ndarray | None:
    """``None`` if the keys are unique, else the codes of some rows that repeat them: evidence, bounded, not an answer."""
    values = group_columns(df, keys)
    counts = df.select(*values).groupBy(*[col(k) for k in keys]).count().filter("count > 1")
    hashes = [r["hash"] for r in counts.select(F.xxhash64(*[col(k) for k in keys]).alias("hash")).limit(_EVIDENCE_KEYS).collect()]
    if not hashes:
        return None
    coded = df.select(F.xxhash64(*values).alias("hash"), codes)
    found = coded.filter(F.col("hash").isin(hashes)).limit(_EVIDENCE_ROWS).collect()
    return np.array([r["codes"] for r in found], dtype="int64")


def _repeats(rows: np.ndarray, columns: Sequence[int]) -> bool:
    return len(np.unique(rows[:, list(columns)], axis=0)) < len(rows)


def validate_keys(
    df: DataFrame, keys: Sequence[str] | None = None, max_columns: int = 3
) -> tuple[tuple[str, ...] | None, bool]:
    """``(keys, True)`` when the given keys exist and are unique in ``df``, else discovery."""
    if keys and all(k in df.columns for k in keys) and not has_duplicates(df, keys):
        return tuple(keys), True
    return find_key(df, max_columns), False


def distinct_counts(df: DataFrame, values: Sequence[tuple[Column, T.DataType]]) -> DataFrame:
    """``position, distinct_count``: the distinct values, null being one, of each of ``values`` (column, type).

    Values of all columns are dealt out together by position and value, after a partial aggregate has left each once per
    task; a row is not carried through the shuffle once per column as several exact distinct counts in one aggregate do.
    """
    entries = []
    for i, (value, dtype) in enumerate(values):
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            value = F.when(value == 0, F.lit(0).cast(dtype)).otherwise(value)  # both zeros are one value
        entries.append(F.struct(F.lit(i).alias("position"), cell_text(comparable(value, dtype), dtype).alias("value")))
    once = df.select(F.inline(F.array(*entries))).groupBy("position", "value").agg(F.lit(1).alias("one"))
    return once.groupBy("position").agg(F.count("*").alias("distinct_count"))


_INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def classify_keys(
    df: DataFrame, uniqueness_threshold: float = 0.95, null_threshold: float = 0.05
) -> DataFrame:
    """Primary, candidate or foreign key per column, from its unique and null ratios and type.

    A null counts as one value in the unique ratio. Columns whose type can be no key are not counted and get no class.
    """
    keyable = {
        f.name: isinstance(f.dataType, (*_INTEGRAL, T.StringType))
        for f in df.schema.fields
        if isinstance(f.dataType, (*_INTEGRAL, T.StringType, T.DoubleType))
    }
    names = list(keyable)
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(col(n).isNull()).alias(f"nulls_{i}") for i, n in enumerate(names)])
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.lit(keyable[n]).alias("exact_type"), F.col(f"nulls_{i}").alias("null_count")
            )
            for i, n in enumerate(names)
        ]
    )
    distinct = distinct_counts(df, [(col(n), df.schema[n].dataType) for n in names])
    profile = counts.filter("rows > 0").select("rows", F.inline(entries)).join(distinct, "position") if names else counts.select(
        F.lit(0).alias("position"), "rows", F.lit("").alias("column_name"), F.lit(False).alias("exact_type"), F.lit(0).alias("null_count"), F.lit(0).alias("distinct_count")).filter("1 = 0")
    unique = F.col("distinct_count") / F.col("rows")
    nulls = F.col("null_count") / F.col("rows")
    low_null = nulls <= null_threshold
    key_class = (
        F.when(F.col("exact_type") & (unique == 1) & (F.col("null_count") == 0), "primary")
        .when((unique >= uniqueness_threshold) & low_null, "candidate")
        .when(F.col("exact_type") & (unique < 1) & low_null, "foreign")
    )
    return profile.select(
        "column_name",
        unique.alias("unique_ratio"),
        nulls.alias("null_ratio"),
        key_class.alias("key_class"),
    )


def align_keys(
    source: DataFrame, target: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Give both sides one type per key: numbers without loss (see ``exact_forms``), all else as text."""
    for key in keys:
        for side, df in (("source", source), ("target", target)):
            if key not in df.columns:
                raise ValueError(f"key column '{key}' not found in {side}")
        left, right = source.schema[key].dataType, target.schema[key].dataType
        if left == right:
            continue
        if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
            forms = exact_forms(col(key), col(key), left, right)
        else:
            forms = (col(key).cast("string"),) * 2
        source, target = source.withColumn(key, forms[0]), target.withColumn(key, forms[1])
    return source, target


def key_overlap(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct key (null equals null): rows on each side.

    Each side is pre-aggregated before the shuffle, so a key that holds a third of all rows
    reaches its reducer as one row per map task.
    """
    source, target = align_keys(source, target, keys)
    left = source.select(*group_columns(source, keys), F.lit(1).alias("s"), F.lit(0).alias("t"))
    right = target.select(*group_columns(target, keys), F.lit(0).alias("s"), F.lit(1).alias("t"))
    return (
        left.unionByName(right)
        .groupBy(*[col(k) for k in keys])
        .agg(F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows"))
    )


def shared_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys on both sides."""
    both = (F.col("source_rows") > 0) & (F.col("target_rows") > 0)
    return key_overlap(source, target, keys).filter(both).select(*[col(k) for k in keys])


def unmatched_keys(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys on one side only, with ``side`` = ``source`` or ``target``."""
    side = F.when(F.col("target_rows") == 0, "source").when(F.col("source_rows") == 0, "target")
    return (
        key_overlap(source, target, keys)
        .select(*[col(k) for k in keys], side.alias("side"))
        .filter("side IS NOT NULL")
    )


def restrict_to_shared(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``; a null key matches a null key."""
    df, other = align_keys(df, other, keys)
    wanted = other.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    match = [df[f"`{k}`"].eqNullSafe(wanted[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(wanted, match, "left_semi")
