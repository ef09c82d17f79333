"""Readers by format name. Nothing is counted or cached on reading, but for one look at XML and at multi-line CSV."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallymark.sources import elements, layouts, quoted

Schema = T.StructType | str | None

# Options of CSV files that only Spark's own reader follows here, and those that a record's parser has no use for.
_WHOLE_FILE_OPTIONS = {
    "linesep", "comment", "mode", "columnnameofcorruptrecord", "encoding", "charset", "multiline", "header",
    "pathglobfilter", "recursivefilelookup", "modifiedbefore", "modifiedafter",
}
_CORRUPT = "_corrupt_record"
_SCAN_OPTIONS = {"header", "encoding", "multiLine", "inferSchema"}


def _reader(spark: SparkSession, options: Mapping[str, Any] | None, schema: Schema):
    reader = spark.read.options(**dict(options or {}))
    return reader.schema(schema) if schema is not None else reader


def read_csv(
    spark: SparkSession,
    path: str,
    header: bool = True,
    delimiter: str = ",",
    infer_schema: bool = False,
    schema: Schema = None,
    encoding: str = "utf-8",
    null_value: str | None = None,
    date_format: str | None = None,
    timestamp_format: str | None = None,
    quote: str = '"',
    escape: str = "\\",
    multi_line: bool = False,
    options: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Delimited text. Without a schema every column is text, unless ``infer_schema``.

    With ``multi_line``, files are read in byte ranges (see ``quoted``) unless their encoding is not UTF-8 or the options
    name a line separator, a comment sign, a mode or a choice of files; those go to Spark's reader, a task per file.
    """
    named = {
        "header": header, "delimiter": delimiter, "encoding": encoding, "quote": quote, "escape": escape,
        "multiLine": multi_line, "inferSchema": infer_schema and schema is None, "nullValue": null_value,
        "dateFormat": date_format, "timestampFormat": timestamp_format,
    }
    given = {k: v for k, v in named.items() if v is not None}
    given |= options or {}
    whole = _reader(spark, given, schema).csv(path)
    plain = encoding.lower() in ("utf-8", "utf8") and not {k.lower() for k in options or {}} & _WHOLE_FILE_OPTIONS
    if not (multi_line and plain):
        return whole
    return quoted.read_quoted_csv(spark, path, whole.schema, {k: v for k, v in given.items() if k not in _SCAN_OPTIONS}, header)


def read_psv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return read_csv(spark, path, **{"delimiter": "|", **options})


def read_json(
    spark: SparkSession, path: str, multi_line: bool = False, schema: Schema = None, options: Mapping[str, Any] | None = None
) -> DataFrame:
    return _reader(spark, {"multiLine": multi_line, **(options or {})}, schema).json(path)


def read_xml(
    spark: SparkSession, path: str, row_tag: str = "row", mode: str = "PERMISSIVE", schema: Schema = None,
    options: Mapping[str, Any] | None = None,
) -> DataFrame:
    """XML elements. With a schema, files are read in byte ranges (see ``elements``) if their text allows it; otherwise, with
    further options or a column of corrupt records, they go to Spark's reader, a task per file.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = wanted is not None and not options and mode.upper() in ("PERMISSIVE", "FAILFAST")
    if plain and _CORRUPT not in wanted.names and elements.can_be_cut(spark, path, row_tag):
        return elements.read_elements(spark, path, row_tag, wanted, mode)
    return _reader(spark, {"rowTag": row_tag, "mode": mode, **(options or {})}, schema).xml(path)


def read_episodic(spark: SparkSession, path: str, row_tag: str = "record", **options: Any) -> DataFrame:
    return read_xml(spark, path, row_tag=row_tag, **options)


def read_parquet(spark: SparkSession, path: str, options: Mapping[str, Any] | None = None) -> DataFrame:
    return _reader(spark, options, None).parquet(path)


def read_avro(spark: SparkSession, path: str, options: Mapping[str, Any] | None = None) -> DataFrame:
    """Needs the Avro module on the class path."""
    return _reader(spark, options, None).format("avro").load(path)


def read_fixed_length(spark: SparkSession, path: str, fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    return layouts.fixed_length(spark.read.text(path), fields)


def read_fixed_width(spark: SparkSession, path: str, fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    return layouts.fixed_width(spark.read.text(path), fields)


def read_typed_fixed_width(spark: SparkSession, path: str, fields: Sequence[Mapping[str, Any]]) -> DataFrame:
    return layouts.typed_fixed_width(spark.read.text(path), fields)


def read_ebcdic(
    spark: SparkSession, path: str, fields: Sequence[Mapping[str, Any]], record_length: int = 80, charset: str = "IBM1047"
) -> DataFrame:
    """Fixed-length EBCDIC records, decoded by a field layout."""
    return layouts.decode_records(layouts.read_binary_records(spark, path, record_length), fields, charset)


def read_record_types(
    spark: SparkSession, path: str, record_types: Mapping[str, Any], separator: str | None = None,
    data_record_types: Sequence[str] | None = None, include_record_type: bool = True,
) -> dict[str, DataFrame]:
    """Files that mix record types, as one DataFrame per type; delimited when a separator is given."""
    lines = spark.read.text(path)
    if separator is not None:
        return layouts.record_type_delimited(lines, record_types, separator)
    return layouts.record_type_fixed_width(lines, record_types, data_record_types or list(record_types), include_record_type)


def read_delimited_lines(spark: SparkSession, path: str, fields: Sequence[str], separator: str = "|") -> DataFrame:
    return layouts.delimited_lines(spark.read.text(path), fields, separator)


def read_table(spark: SparkSession, path: str | None = None, *, database: str, table: str) -> DataFrame:
    return spark.table(f"`{database}`.`{table}`")


def read_query(
    spark: SparkSession, path: str | None = None, *, query: str, args: Mapping[str, Any] | None = None
) -> DataFrame:
    return spark.sql(query, args=dict(args) if args else None)


def read_bigquery(spark: SparkSession, path: str | None = None, *, project_id: str, dataset: str, table: str) -> DataFrame:
    """Needs the BigQuery connector on the class path."""
    return spark.read.format("bigquery").options(project=project_id, dataset=dataset, table=table).load()


# The SQL Server address, encrypted and trusting the server's certificate, and its driver.
SQL_SERVER_URL = "jdbc:sqlserver://{hostname}:{port};databaseName={database};encrypt=true;trustServerCertificate=true"
SQL_SERVER_DRIVER = "com.microsoft.sqlserver.jdbc.SQLServerDriver"


def jdbc_url(hostname: str, port: int | str, database: str) -> str:
    """A SQL Server address that encrypts and trusts the server's certificate."""
    return SQL_SERVER_URL.format(hostname=hostname, port=port, database=database)


def jdbc_options(
    hostname: str, port: int | str, database: str, username: str, password: str, table: str,
    driver: str = SQL_SERVER_DRIVER, url: str | None = None,
) -> dict[str, str]:
    return {
        "url": url or jdbc_url(hostname, port, database), "user": username, "password": password, "driver": driver,
        "dbtable": table,
    }


def read_jdbc(
    spark: SparkSession,
    path: str | None = None,
    *,
    partition_column: str | None = None,
    lower_bound: Any = None,
    upper_bound: Any = None,
    num_partitions: int | None = None,
    **connection: Any,
) -> DataFrame:
    """Needs the driver on the class path. With a partition column the table is read in parallel."""
    options: dict[str, Any] = jdbc_options(**connection)
    split = {
        "partitionColumn": partition_column, "lowerBound": lower_bound, "upperBound": upper_bound,
        "numPartitions": num_partitions,
    }
    given = {k: v for k, v in split.items() if v is not None}
    if given and len(given) != len(split):
        raise ValueError(f"a parallel read needs all of {sorted(split)}")
    return spark.read.format("jdbc").options(**options, **given).load()


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv,
    "psv": read_psv,
    "json": read_json,
    "xml": read_xml,
    "episodic": read_episodic,
    "parquet": read_parquet,
    "avro": read_avro,
    "fixedlength": read_fixed_length,
    "fixedwidth": read_fixed_width,
    "ebcdic": read_ebcdic,
    "mainframe": read_ebcdic,
    "hive": read_table,
    "hql": read_query,
    "bigquery": read_bigquery,
    "jdbc": read_jdbc,
    "lines": read_delimited_lines,
}


def read_dataset(
    spark: SparkSession,
    fmt: str,
    path: str | None = None,
    partition_filter: str | None = None,
    **arguments: Any,
) -> DataFrame:
    """Read by format name; every argument reaches the format's reader.

    ``partition_filter`` is a predicate on partition columns, which prunes what is read.
    """
    if fmt.lower() not in READERS:
        raise ValueError(f"unsupported format '{fmt}', known: {sorted(READERS)}")
    df = READERS[fmt.lower()](spark, path, **arguments)
    return df.filter(partition_filter) if partition_filter else df
