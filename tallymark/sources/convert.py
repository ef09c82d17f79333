"""Format conversions. Each takes a specification and gives back what was written."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.copies import unroll_copies
from tallymark.operators.keys import col
from tallymark.operators.transforms import array_columns, explode_arrays, flatten_structs
from tallymark.session import broadcast_if_small, durable
from tallymark.sources import layouts, readers, writers


@dataclass(frozen=True)
class Conversion:
    """What to convert: ``kind`` is a key of :data:`CONVERSIONS`, ``params`` its own arguments."""

    kind: str
    input_path: str
    output_path: str
    delimiter: str = ","
    header: bool = True
    append: bool = False
    params: Mapping[str, Any] = field(default_factory=dict)


def output_format(delimiter: str) -> str:
    return "PSV" if delimiter == "|" else "CSV"


def _text_cells(df: DataFrame) -> DataFrame:
    """Arrays and maps that are left become JSON text, which delimited text can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name) for f in df.schema.fields
    ])


def schema_from_text(text: str) -> T.StructType:
    """A schema given as JSON or as DDL."""
    stripped = text.strip()
    return T.StructType.fromJson(json.loads(stripped)) if stripped.startswith("{") else T.StructType.fromDDL(stripped)


def _csv_to_psv(spark: SparkSession, c: Conversion) -> dict[str, DataFrame]:
    source = readers.read_csv(spark, c.input_path, header=c.header, delimiter=c.params.get("input_delimiter", ","))
    return {c.output_path: source}


def _json_to_csv(spark: SparkSession, c: Conversion) -> dict[str, DataFrame]:
    df = readers.read_json(spark, c.input_path, multi_line=c.params.get("multi_line", True), schema=c.params.get("schema"))
    if c.params.get("flatten", True):
        df = flatten_structs(explode_arrays(flatten_structs(df), c.params.get("explode")))
    return {c.output_path: _text_cells(df)}


def _xml_to_csv(spark: SparkSession, c: Conversion) -> dict[str, DataFrame]:
    if not c.params.get("row_tag"):
        raise ValueError("row_tag is required")
    schema = c.params.get("schema")
    parsed = schema_from_text(schema) if isinstance(schema, str) else schema
    df = readers.read_xml(spark, c.input_path, row_tag=c.params["row_tag"], schema=parsed)
    return {c.output_path: _text_cells(flatten_structs(df))}


def _fixed_width_to_csv(spark: SparkSession, c: Conversion) -> dict[str, DataFrame]:
    lines = spark.read.text(c.input_path)
    if "record_types" in c.params:
        tables = layouts.record_type_fixed_width(
            lines, c.params["record_types"], c.params["data_record_types"], c.params.get("include_record_type", True)
        )
        if len(tables) == 1:
            return {c.output_path: next(iter(tables.values()))}
        return {_child_path(c.output_path, name): df for name, df in tables.items()}
    return {c.output_path: layouts.typed_fixed_width(lines, c.params["fields"])}


def _ebcdic_to_csv(spark: SparkSession, c: Conversion) -> dict[str, DataFrame]:
    names = ("fields", "record_length", "charset")
    arguments = {n: c.params[n] for n in names if n in c.params}
    return {c.output_path: readers.read_ebcdic(spark, c.input_path, **arguments)}


def _child_path(path: str, name: str) -> str:
    """Beside the main output, never inside it, so overwriting one cannot remove the other."""
    return f"{path.rstrip('/')}_{name}"


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a text id that is the same in every run: a digest of the row and its copy number.

    The input is read once and its rows are written with their digests, so that every output made of the result starts from
    there. Only digests are shuffled; a row whose digest is its own is number 1 where it lies. Repeated rows are counted by
    partial aggregation and unrolled in chunks, so a row that is repeated very often is not numbered in one task.
    """
    digest, copies, match = (stem + "_" * (1 + max((len(c) for c in df.columns), default=0)) for stem in ("digest", "copies", "match"))
    row = F.struct(*[col(c) for c in df.columns])
    written = durable(df.withColumn(digest, F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)))
    counts = durable(written.groupBy(digest).agg(F.count("*").alias(copies)).filter(F.col(copies) > 1))
    known = broadcast_if_small(counts.select(F.col(digest).alias(match)))
    own = F.col(digest) == F.col(match)
    single = written.join(known, own, "left_anti").select(*[col(c) for c in df.columns], F.concat(digest, F.lit("-1")).alias(name))
    repeated = written.join(known, own, "left_semi").groupBy(F.col(digest).alias("_digest")).agg(F.any_value(row).alias("_row"), F.count("*").alias("_n"))
    numbered = unroll_copies(repeated, "_n", "_copy", ["_digest"])
    row_id = F.concat("_digest", F.lit("-"), F.col("_copy").cast("string")).alias(name)
    return single.unionByName(numbered.select(*[F.col("_row")[c].alias(c) for c in df.columns], row_id))


def split_episodes(df: DataFrame, episode_id: str = "episode_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The parent without arrays, and one child table per array column keyed by the episode id."""
    if array_columns(df) and episode_id not in df.columns:
        df = with_row_id(df, episode_id)
    arrays = array_columns(df)
    parent = df.select(*[col(c) for c in df.columns if c not in arrays])
    children = {
        name: flatten_structs(df.select(col(episode_id), F.explode(col(name)).alias(f"{name}_item"))) for name in arrays
    }
    return parent, children


def _episodic_to_csv(spark: SparkSession, c: Conversion) -> dict[str, DataFrame]:
    fmt = str(c.params.get("file_format", "json")).lower()
    if fmt == "json":
        df = readers.read_json(spark, c.input_path, multi_line=c.params.get("multi_line", True), schema=c.params.get("schema"))
    elif fmt == "xml":
        if not c.params.get("root_element"):
            raise ValueError("root_element is required for XML files")
        df = readers.read_xml(spark, c.input_path, row_tag=c.params["root_element"], schema=c.params.get("schema"))
    elif fmt == "custom" and "record_types" in c.params:
        tables = readers.read_record_types(
            spark, c.input_path, c.params["record_types"], separator=c.params.get("line_separator", "|")
        )
        return {_child_path(c.output_path, name): table for name, table in tables.items()}
    elif fmt == "custom":
        df = readers.read_delimited_lines(spark, c.input_path, c.params["fields"], c.params.get("line_separator", "|"))
    else:
        raise ValueError(f"Unsupported file format: {fmt}")
    if not c.params.get("flatten", True):
        return {c.output_path: _text_cells(df)}
    parent, children = split_episodes(df, c.params.get("episode_identifier", "episode_id"))
    out = {c.output_path: _text_cells(flatten_structs(parent))}
    for name, child in children.items():
        out[_child_path(c.output_path, f"{name}_items")] = _text_cells(child)
    return out


CONVERSIONS: dict[str, Callable[[SparkSession, Conversion], dict[str, DataFrame]]] = {
    "csv_to_psv": _csv_to_psv,
    "json_to_csv": _json_to_csv,
    "xml_to_csv": _xml_to_csv,
    "fixed_width_to_csv": _fixed_width_to_csv,
    "ebcdic_to_csv": _ebcdic_to_csv,
    "episodic_to_csv": _episodic_to_csv,
}


def convert(
    spark: SparkSession, spec: Conversion | Mapping[str, Any], input_path: str | None = None, output_path: str | None = None
) -> list[dict[str, Any]]:
    """Run one conversion and report each table written: path, rows, columns, format, status.

    ``input_path`` and ``output_path`` replace those of the specification. A conversion that
    fails is reported with status ``error`` instead of raising.
    """
    c = spec if isinstance(spec, Conversion) else Conversion(**spec)
    c = replace(c, input_path=input_path or c.input_path, output_path=output_path or c.output_path)
    if c.kind == "csv_to_psv" and c.delimiter == ",":
        c = replace(c, delimiter="|")
    base = {"conversion": c.kind, "input_path": c.input_path}
    done: list[dict[str, Any]] = []
    path = c.output_path
    try:
        if c.kind not in CONVERSIONS:
            raise ValueError(f"unknown conversion '{c.kind}'")
        tables = CONVERSIONS[c.kind](spark, c)
        _refuse_overlap(spark, c.input_path, list(tables))
        for path, df in tables.items():
            rows = writers.write_delimited(df, path, c.delimiter, c.header, c.append)
            done.append({
                **base, "output_path": path, "rows_processed": rows, "columns_processed": len(df.columns),
                "output_format": output_format(c.delimiter), "status": "success",
            })
    except Exception as error:  # the report carries whatever went wrong
        done.append({**base, "output_path": path, "status": "error", "error_message": str(error)})
    return done


def _places(spark: SparkSession, path: str) -> list[str]:
    """What a path, relative, with ``..`` or a scheme or as a glob, stands for: qualified paths, and the folder a glob starts in."""
    context = spark.sparkContext
    given = context._jvm.org.apache.hadoop.fs.Path(path)
    system = given.getFileSystem(context._jsc.hadoopConfiguration())
    qualified = system.makeQualified(given)
    found = [qualified, *((f.getPath() for f in system.globStatus(qualified) or []))]
    while re.search(r"[*?\[{]", found[0].toString()):
        found[0] = found[0].getParent()
    return [p.toString().rstrip("/") + "/" for p in found]


def _refuse_overlap(spark: SparkSession, source: str, targets: Sequence[str]) -> None:
    """No table may lie in, above or on the input, nor in, above or on another table."""
    inputs = _places(spark, source)
    written: list[str] = []
    for target in targets:
        (place, *_) = _places(spark, target)
        if any(place.startswith(other) or other.startswith(place) for other in inputs):
            raise ValueError(f"refusing to write {target} over its own input {source}")
        if any(place.startswith(other) or other.startswith(place) for other in written):
            raise ValueError(f"refusing to write {target} over another table of the conversion")
        written.append(place)


def convert_all(
    spark: SparkSession, specs: Sequence[Conversion | Mapping[str, Any]], input_path: str | None = None, output_path: str | None = None
) -> list[dict[str, Any]]:
    """Run a list of conversions in order, with the same overrides for each."""
    return [report for spec in specs for report in convert(spark, spec, input_path, output_path)]
