"""Row and cell comparison of a source and a target by key.

Everything starts from :func:`pair_rows`, one row per source/target pair, and adds column
statistics, row differences, cell differences and samples on top.

Pairings, and how each holds up when one key has a third of all rows:

* ``unique`` - keys repeat on neither side: one full outer join, whose keys are spread evenly.
* ``first`` - a repeated target key stands for its first row (smallest compared values, nulls
  first), and each source row meets that row. The target is reduced by a partial aggregate, and
  the joins are left outer and left anti, whose big left side adaptive execution can split.
* ``occurrence`` - rows of a key that are equal on both sides cancel each other, by count, and are not listed; of what
  is left, the n-th row in the order of the compared columns meets the n-th one on the other side. Equal rows
  are never unrolled, and numbering deals rows out by key and value, so any key is spread.
* ``auto`` - ``unique`` if no key repeats on either side, else ``first``.

``unique`` fails on a repeated key. A null key equals a null key everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.compare import cell_text, common_forms, comparable, comparable_type, differs, holds_map, is_nested
from tallymark.operators.copies import unroll_copies
from tallymark.operators.keys import align_keys, col, group_columns, has_duplicates
from tallymark.operators.profile import percent
from tallymark.operators.schema import common_columns
from tallymark.session import durable

PAIRINGS = ("auto", "unique", "first", "occurrence")

_IN_SOURCE, _IN_TARGET = "_in_source", "_in_target"
_OCCURRENCE = "occurrence"
# Float cells whose sign is kept in one long.
_SIGN_BITS = 60


@dataclass(frozen=True)
class PairedRows:
    """Paired rows: the keys, ``_in_source``/``_in_target`` flags, and ``s_<i>``/``t_<i>`` cells.

    ``sides`` are the source and target of pairs that leave out equal rows: what of them is not here has an equal row on
    the other side.
    """

    df: DataFrame
    keys: list[str]
    columns: list[str]
    source_types: list[T.DataType]
    target_types: list[T.DataType]
    null_mode: str = "safe"
    extra_keys: list[str] = field(default_factory=list)
    sides: tuple[DataFrame, DataFrame] | None = None

    def cells(self) -> list[tuple[str, Column, Column, Column]]:
        """``(name, source cell, target cell, differs)`` per compared column."""
        out = []
        for i, name in enumerate(self.columns):
            s, t = F.col(f"s_{i}"), F.col(f"t_{i}")
            out.append((name, s, t, differs(s, t, self.source_types[i], self.target_types[i], self.null_mode)))
        return out

    @property
    def key_columns(self) -> list[Column]:
        return [col(k) for k in [*self.keys, *self.extra_keys]]

    @property
    def matched(self) -> Column:
        return F.col(_IN_SOURCE).isNotNull() & F.col(_IN_TARGET).isNotNull()


def first_match(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: its first row in the order of ``columns`` (nulls first).

    A minimum over a struct instead of a sorted window: partial aggregation leaves one row per
    key and map task, however often the key repeats.
    """
    if not columns:
        return df.select(*group_columns(df, keys)).distinct()
    row = F.struct(*[col(c) for c in columns])
    if any(holds_map(df.schema[c].dataType) for c in columns):
        # A map cannot be sorted, so order by its sortable form.
        sortable = [comparable(col(c), df.schema[c].dataType).alias(f"o{i}") for i, c in enumerate(columns)]
        first = F.min_by(row, F.struct(*sortable))
    else:
        first = F.min(row)
    prepared = df.select(*group_columns(df, keys), *[col(c) for c in columns])
    return (
        prepared.groupBy(*[col(k) for k in keys])
        .agg(first.alias("_first"))
        .select(*[col(k) for k in keys], *[F.col("_first")[c].alias(c) for c in columns])
    )


def _float_signs(floats: Sequence[int]) -> Column:
    """One bit per float cell that is -0.0, which grouping turns into 0.0."""
    bits = [F.when((F.col(f"o_{i}") == 0) & F.col(f"o_{i}").cast("string").startswith("-"), 1 << bit).otherwise(0) for bit, i in enumerate(floats)]
    return sum(bits, F.lit(0)).cast("long")


def _pair_occurrences(source: DataFrame, target: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """What is left after equal rows have cancelled each other by count, paired by its number within the key.

    One aggregate over both sides counts the rows, so that each is shuffled once; rows that cancel are never written. A cell
    that can be shown as it is grouped travels once, any other also as it was.
    """
    n = range(len(names))
    types = [(source.schema[c].dataType, target.schema[c].dataType) for c in names]
    forms = [common_forms(F.col(f"o_{i}"), F.col(f"o_{i}"), *types[i]) for i in n]
    real = (T.FloatType, T.DoubleType)
    floats = [i for i in n if types[i][0] == types[i][1] and isinstance(types[i][0], real)][:_SIGN_BITS]
    plain = [i for i in n if i in floats or types[i][0] == types[i][1] and not is_nested(types[i][0]) and not isinstance(types[i][0], real)]
    carried = [i for i in n if i not in plain]
    key_names, cell_names = [f"k_{i}" for i in range(len(keys))], [f"c_{i}" for i in n]
    groups = [*key_names, *cell_names]
    sides, kept = [], {"s": [], "t": []}
    for at, (side, df) in enumerate((("s", source), ("t", target))):
        raw = df.select(
            *[k.alias(f"k_{i}") for i, k in enumerate(group_columns(df, keys))],
            *[comparable(col(c), df.schema[c].dataType).alias(f"o_{i}") for i, c in enumerate(names)])
        # The form in which cells are equal, with whether the target's could not be read at all.
        cells = [
            (F.col(f"o_{i}") if i in plain else F.struct(f[at].alias("v"), (f[2] if at else F.lit(False)).alias("u"))).alias(f"c_{i}")
            for i, f in enumerate(forms)]
        own = {f"{side}_signs": _float_signs(floats)} if floats else {}
        if carried:
            own[f"{side}_shown"] = F.struct(*[f"o_{i}" for i in carried])
        kept[side] = list(own)
        counts = [F.lit(int(side == c)).cast("long").alias(f"n_{c}") for c in "st"]
        sides.append(raw.select(*key_names, *cells, *counts, *[value.alias(name) for name, value in own.items()]))
    rows = sides[0].unionByName(sides[1], allowMissingColumns=True)
    counted = rows.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in ("n_s", "n_t")], *[F.min(c).alias(c) for side in "st" for c in kept[side]])
    left_over = durable(counted.where("n_s <> n_t"))

    lone = {}
    for side, other in ("st", "ts"):
        mine = left_over.withColumn("n", F.col(f"n_{side}") - F.col(f"n_{other}")).where("n > 0")
        lone[side] = _number_left_over(mine, key_names, groups, kept[side])
    left, right = lone["s"].alias("l"), lone["t"].alias("r")
    in_source, in_target = F.col(f"l.{_OCCURRENCE}").isNotNull(), F.col(f"r.{_OCCURRENCE}").isNotNull()

    def shown(side: str, rows: str, i: int) -> Column:
        if i in carried:
            return F.col(f"{rows}.{side}_shown")[f"o_{i}"]
        cell = F.col(f"{rows}.c_{i}")
        if i not in floats:
            return cell
        negative = F.col(f"{rows}.{side}_signs").bitwiseAND(F.lit(1 << floats.index(i)).cast("long")) != 0
        return F.when(negative, F.lit(-0.0).cast(types[i][0])).otherwise(cell)

    match = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in [*key_names, _OCCURRENCE]]
    # Written once: statistics, differences and samples all read it.
    return durable(left.join(right, match, "full_outer").select(
        *[F.coalesce(f"l.k_{i}", f"r.k_{i}").alias(k) for i, k in enumerate(keys)], F.coalesce(f"l.{_OCCURRENCE}", f"r.{_OCCURRENCE}").alias(_OCCURRENCE),
        F.when(in_source, F.lit(1)).alias(_IN_SOURCE), F.when(in_target, F.lit(1)).alias(_IN_TARGET),
        *[shown("s", "l", i).alias(f"s_{i}") for i in n], *[shown("t", "r", i).alias(f"t_{i}") for i in n]))


def _number_left_over(rows: DataFrame, keys: Sequence[str], order: Sequence[str], more: Sequence[str]) -> DataFrame:
    """One row per copy, columns ``order`` and ``more``, with its 1-based number within the key in the order of ``order`` (nulls first).

    Rows are dealt out by range over key and cells and numbered within each part of a key; the parts' sums, a row per key
    and part, shift them. So a frequent key is spread like any other, and every size takes this path.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    parts = durable(rows.select(*order, *more, "n").repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy("part", *keys).orderBy(*by).rowsBetween(*before)
    placed = parts.withColumn("_skip", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    sums = parts.groupBy("part", *keys).agg(F.sum("n").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(*before)
    shifts = sums.select(
        F.col("part").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    match = [F.col("part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
    ranges = placed.join(shifts, match).select(*order, *more, "n", (F.col("_skip") + F.col("_shift")).alias("_before"))
    unrolled = unroll_copies(ranges, "n", "_copy", [*keys, "_before"])
    return unrolled.select(*order, *more, (F.col("_before") + F.col("_copy")).alias(_OCCURRENCE))


def pair_rows(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    pairing: str = "auto",
    null_mode: str = "safe",
    checked: bool = False,
) -> PairedRows:
    """Pair source and target rows by key; see the module text for ``pairing``.

    ``checked`` says that the keys are known to be unique where ``unique`` is asked for.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("No suitable key columns found")
    if pairing not in PAIRINGS:
        raise ValueError(f"pairing must be one of {PAIRINGS}")
    source, target = align_keys(source, target, keys)
    names = common_columns(source, target, exclude=keys)
    if columns is not None:
        unknown = [c for c in columns if c not in names]
        if unknown:
            raise ValueError(f"columns not on both sides: {unknown}")
        names = list(columns)
    if pairing in ("auto", "unique") and not checked:
        repeated = has_duplicates(source, keys) or has_duplicates(target, keys)
        if repeated and pairing == "unique":
            raise ValueError(f"key {keys} repeats; name another pairing")
        pairing = "first" if repeated else "unique"
    extra: list[str] = []
    if pairing == "first":
        paired = _pair_first(source, target, keys, names)
    elif pairing == "occurrence":
        paired, extra = _pair_occurrences(source, target, keys, names), [_OCCURRENCE]
    else:
        paired = _full_join(source, target, keys, names)
    types = [
        [comparable_type(df.schema[c].dataType) if pairing == "occurrence" else df.schema[c].dataType for c in names] for df in (source, target)
    ]
    return PairedRows(paired, keys, names, *types, null_mode, extra, (source, target) if pairing == "occurrence" else None)


def _side(df: DataFrame, keys: Sequence[str], names: Sequence[str], prefix: str, flag: str) -> DataFrame:
    return df.select(
        *[comparable(col(k), df.schema[k].dataType).alias(f"{prefix}k_{i}") for i, k in enumerate(keys)],
        *[col(c).alias(f"{prefix}_{i}") for i, c in enumerate(names)],
        F.lit(1).alias(flag),
    )


def _match(n_keys: int) -> list[Column]:
    return [F.col(f"sk_{i}").eqNullSafe(F.col(f"tk_{i}")) for i in range(n_keys)]


def _full_join(source: DataFrame, target: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    left = _side(source, keys, names, "s", _IN_SOURCE)
    right = _side(target, keys, names, "t", _IN_TARGET)
    joined = left.join(right, _match(len(keys)), "full_outer")
    cells = range(len(names))
    return joined.select(
        *[F.coalesce(F.col(f"sk_{i}"), F.col(f"tk_{i}")).alias(k) for i, k in enumerate(keys)],
        _IN_SOURCE,
        _IN_TARGET,
        *[f"s_{i}" for i in cells],
        *[f"t_{i}" for i in cells],
    )


def _pair_first(source: DataFrame, target: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    cells = range(len(names))
    left = _side(source, keys, names, "s", _IN_SOURCE)
    first = _side(first_match(target, keys, names), keys, names, "t", _IN_TARGET)
    with_source = left.join(first, _match(len(keys)), "left_outer").select(
        *[F.col(f"sk_{i}").alias(k) for i, k in enumerate(keys)],
        _IN_SOURCE,
        _IN_TARGET,
        *[f"s_{i}" for i in cells],
        *[f"t_{i}" for i in cells],
    )
    every_target = _side(target, keys, names, "t", _IN_TARGET)
    source_keys = left.select(*[f"sk_{i}" for i in range(len(keys))]).distinct()
    target_only = every_target.join(source_keys, _match(len(keys)), "left_anti").select(
        *[F.col(f"tk_{i}").alias(k) for i, k in enumerate(keys)],
        F.lit(None).cast("int").alias(_IN_SOURCE),
        _IN_TARGET,
        *[F.lit(None).cast(left.schema[f"s_{i}"].dataType).alias(f"s_{i}") for i in cells],
        *[f"t_{i}" for i in cells],
    )
    return with_source.unionByName(target_only)


def _with_equal_rows(pairs: PairedRows, sources: Sequence[Column], targets: Sequence[Column], different: Sequence[Column], nulls) -> DataFrame:
    """One row of sums over all pairs, from those over the whole sides and over the rows that have no partner."""
    lone_source, lone_target = F.col(_IN_TARGET).isNull(), F.col(_IN_SOURCE).isNull()
    listed = pairs.df.agg(
        F.count_if(lone_source).alias("lone"), *nulls("ls", lone_source, sources), *nulls("lt", lone_target, targets), *different)
    source, target = pairs.sides
    yes, names = F.lit(True), [col(c) for c in pairs.columns]
    every_source, every_target = source.agg(F.count("*").alias("rows"), *nulls("as", yes, names)), target.agg(*nulls("at", yes, names))
    n = range(len(names))
    return listed.crossJoin(every_source).crossJoin(every_target).select(
        (F.col("rows") - F.col("lone")).alias("total"), *[(F.col(f"as{i}") - F.col(f"ls{i}")).alias(f"sn{i}") for i in n],
        *[(F.col(f"at{i}") - F.col(f"lt{i}")).alias(f"tn{i}") for i in n], *[f"d{i}" for i in n])


def column_stats(pairs: PairedRows) -> DataFrame:
    """Per compared column: rows, nulls per side, passes, pass percentage and status.

    All columns come from one aggregate over the paired rows. Equal rows that were left out are counted as all rows of a side
    but those listed. ``PASS`` needs exactly 100 %.
    """
    cells = pairs.cells()
    if not cells:
        empty = (
            "column_name string, total_records long, source_null_count long, source_not_null_count long, "
            "target_null_count long, target_not_null_count long, pass_count long, pass_percentage double, status string"
        )
        return pairs.df.sparkSession.createDataFrame([], empty)
    def nulls(prefix: str, condition: Column, mine: Sequence[Column]) -> list[Column]:
        return [F.count_if(condition & c.isNull()).alias(f"{prefix}{i}") for i, c in enumerate(mine)]

    sources, targets = [s for _, s, _, _ in cells], [t for _, _, t, _ in cells]
    different = [F.count_if(pairs.matched & differ).alias(f"d{i}") for i, (*_, differ) in enumerate(cells)]
    if pairs.sides is None:
        yes = F.lit(True)
        summed = pairs.df.filter(pairs.matched).agg(F.count("*").alias("total"), *nulls("sn", yes, sources), *nulls("tn", yes, targets), *different)
    else:
        summed = _with_equal_rows(pairs, sources, targets, different, nulls)
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(f"sn{i}").alias("source_nulls"),
            F.col(f"tn{i}").alias("target_nulls"),
            F.col(f"d{i}").alias("different"),
        )
        for i, (name, *_) in enumerate(cells)
    ]
    long = summed.select("total", F.inline(F.array(*entries)))
    passed = F.col("total") - F.col("different")
    share = percent(passed, F.col("total"))
    return long.select(
        "column_name",
        F.col("total").alias("total_records"),
        F.col("source_nulls").alias("source_null_count"),
        (F.col("total") - F.col("source_nulls")).alias("source_not_null_count"),
        F.col("target_nulls").alias("target_null_count"),
        (F.col("total") - F.col("target_nulls")).alias("target_not_null_count"),
        passed.alias("pass_count"),
        share.alias("pass_percentage"),
        F.when(share == 100, "PASS").otherwise("FAIL").alias("status"),
    )


def row_diff(pairs: PairedRows) -> DataFrame:
    """Rows that disagree: the keys, ``status``, and ``differences`` with one entry per cell."""
    entries = [
        F.when(
            pairs.matched & differ,
            F.struct(
                F.lit(name).alias("column"),
                cell_text(s, pairs.source_types[i]).alias("source_value"),
                cell_text(t, pairs.target_types[i]).alias("target_value"),
            ),
        )
        for i, (name, s, t, differ) in enumerate(pairs.cells())
    ]
    empty = F.array().cast("array<struct<column:string,source_value:string,target_value:string>>")
    differences = F.array_compact(F.array(*entries)) if entries else empty
    status = (
        F.when(F.col(_IN_TARGET).isNull(), "missing_in_target")
        .when(F.col(_IN_SOURCE).isNull(), "missing_in_source")
        .otherwise("values_differ")
    )
    different = F.lit(False)
    for *_, differ in pairs.cells():
        different = different | differ
    return pairs.df.filter(~pairs.matched | different).select(
        *pairs.key_columns, status.alias("status"), differences.alias("differences")
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Row differences per status."""
    return diff.groupBy("status").agg(F.count("*").alias("row_count"))


def cell_diff(diff: DataFrame) -> DataFrame:
    """One row per differing cell; a row missing on a side gives one row without a cell."""
    keys = [col(c) for c in diff.columns if c != "differences"]
    return diff.select(*keys, F.inline_outer("differences"))


def mismatch_sample(pairs: PairedRows, per_column: int = 100) -> DataFrame:
    """The first ``per_column`` differing cells of each column, in key order.

    Spark keeps the first rows of each column per map task before the shuffle, so a column with
    very many mismatches does not flow into one task.
    """
    cells = cell_diff(row_diff(pairs)).filter("status = 'values_differ'")
    in_order = Window.partitionBy("column").orderBy(*[k.asc_nulls_first() for k in pairs.key_columns])
    return (
        cells.withColumn("_rank", F.row_number().over(in_order))
        .filter(F.col("_rank") <= per_column)
        .select(F.col("column").alias("column_name"), *pairs.key_columns, "source_value", "target_value")
    )


def flag_rows(base: DataFrame, diff: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """``base`` with ``row_missing`` and ``changed_columns`` as found by :func:`row_diff`.

    ``side`` tells whether ``base`` is the ``source`` or the ``target`` of the comparison.
    """
    if side not in ("source", "target"):
        raise ValueError("side must be 'source' or 'target'")
    missing = "missing_in_target" if side == "source" else "missing_in_source"
    names = [col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    per_key = (
        diff.select(*names, "status", F.explode_outer(F.col("differences.column")).alias("_column"))
        .groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(
            F.bool_or(F.col("status") == missing).alias("_missing"),
            F.array_sort(F.collect_set("_column")).alias("_changed"),
        )
    )
    match = [base[f"`{k}`"].eqNullSafe(per_key[f"_k{i}"]) for i, k in enumerate(keys)]
    return base.join(per_key, match, "left_outer").select(
        *[base[f"`{c}`"] for c in base.columns],
        F.coalesce("_missing", F.lit(False)).alias("row_missing"),
        F.coalesce("_changed", F.array().cast("array<string>")).alias("changed_columns"),
    )
