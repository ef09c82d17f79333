"""Value comparison across a source and a target column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MODES = ("safe", "sql")


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))


def comparable(column: Column, dtype: T.DataType) -> Column:
    """The column in a form Spark can compare, group and sort: maps become sorted entry arrays."""
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(column)
        pairs = F.transform(
            entries,
            lambda e: F.struct(
                comparable(e["key"], dtype.keyType).alias("key"),
                comparable(e["value"], dtype.valueType).alias("value"),
            ),
        )
        return F.array_sort(pairs)
    if isinstance(dtype, T.ArrayType) and holds_map(dtype.elementType):
        return F.transform(column, lambda e: comparable(e, dtype.elementType))
    if isinstance(dtype, T.StructType) and holds_map(dtype):
        fields = [comparable(column[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def comparable_type(dtype: T.DataType) -> T.DataType:
    """The type of :func:`comparable`."""
    if isinstance(dtype, T.MapType):
        pair = T.StructType([T.StructField("key", comparable_type(dtype.keyType), False), T.StructField("value", comparable_type(dtype.valueType))])
        return T.ArrayType(pair, False)
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(comparable_type(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, comparable_type(f.dataType), f.nullable) for f in dtype.fields])
    return dtype


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return False


def cell_text(column: Column, dtype: T.DataType) -> Column:
    """A cell as text for reports."""
    return F.to_json(column) if is_nested(dtype) else column.cast("string")


_INTEGRAL_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _digits(dtype: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point of an exact numeric type, else None."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    digits = _INTEGRAL_DIGITS.get(type(dtype))
    return None if digits is None else (digits, 0)


def exact_forms(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType) -> tuple[Column, Column]:
    """Two numbers of different types in forms that are equal exactly when the numbers are.

    Integers and decimals meet in a decimal that holds both, or, where none is wide enough, in their shortest text. A
    float meets an exact number in the text of the exact type; it has one only if casting there and back returns it.
    """
    a, b = _digits(left_type), _digits(right_type)
    if a and b:
        whole, scale = max(a[0], b[0]), max(a[1], b[1])
        if whole + scale <= 38:
            common = "long" if scale == 0 and whole <= 19 and not isinstance(left_type, T.DecimalType) and not isinstance(right_type, T.DecimalType) else f"decimal({whole + scale},{scale})"
            return left.cast(common), right.cast(common)
        return _shortest(left), _shortest(right)
    if a is None and b is None:
        return left.cast("double"), right.cast("double")
    if a is None:
        return _as_exact(left, right_type), right.cast("string")
    return left.cast("string"), _as_exact(right, left_type)


def _shortest(number: Column) -> Column:
    text = number.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _as_exact(number: Column, exact_type: T.DataType) -> Column:
    double = number.cast("double")
    cast = double.try_cast(exact_type)
    return F.when(cast.cast("double") == double, cast.cast("string")).otherwise(F.concat(F.lit("~"), double.cast("string")))


def common_forms(
    source: Column, target: Column, source_type: T.DataType, target_type: T.DataType
) -> tuple[Column, Column, Column]:
    """Both cells in one type, in which they can be compared, grouped and sorted, and whether the target cannot be read as
    the source's type. Numbers are aligned without loss; other types are cast to the source's.
    """
    readable = F.lit(False)
    if source_type == target_type:
        return comparable(source, source_type), comparable(target, target_type), readable
    if is_nested(source_type) or is_nested(target_type):
        return cell_text(source, source_type), cell_text(target, target_type), readable
    if isinstance(source_type, T.NumericType) and isinstance(target_type, T.NumericType):
        return *exact_forms(source, target, source_type, target_type), readable
    cast = target.try_cast(source_type)
    return source, cast, target.isNotNull() & cast.isNull()


def differs(
    source: Column,
    target: Column,
    source_type: T.DataType,
    target_type: T.DataType,
    null_mode: str = "safe",
) -> Column:
    """Whether two cells differ; never null.

    ``safe``: a null equals only a null. ``sql``: a null on either side is no difference.
    Numbers of different types are compared exactly; other types are aligned to the source type, and
    a target value that cannot be cast is a difference, as is any value next to it.
    """
    if null_mode not in NULL_MODES:
        raise ValueError(f"null_mode must be one of {NULL_MODES}")
    source, target, unreadable = common_forms(source, target, source_type, target_type)
    if null_mode == "safe":
        return ~source.eqNullSafe(target) | unreadable
    return F.coalesce(source != target, F.lit(False)) | (unreadable & source.isNotNull())
