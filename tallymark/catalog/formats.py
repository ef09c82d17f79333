"""Queries: every file format, written from a given table and read back whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.catalog import inputs
from tallymark.session import scratch_path
from tallymark.sources import convert, layouts, readers, writers

_TIME = "yyyy-MM-dd HH:mm:ss"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "orders")


def _csv_of_orders(spark: SparkSession, sf_dir: str, delimiter: str = ",") -> str:
    path = scratch_path(spark, "orders-csv")
    writers.write_delimited(_orders(spark, sf_dir), path, delimiter, options={"timestampNTZFormat": _TIME})
    return path


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_dataset(spark, "csv", _csv_of_orders(spark, sf_dir))


def csv_scan_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    path = _csv_of_orders(spark, sf_dir, ";")
    return readers.read_dataset(
        spark, "csv", path, delimiter=";", schema=schema, null_value="P", options={"timestampNTZFormat": _TIME}
    )


def csv_scan_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks, types inferred."""
    path = scratch_path(spark, "turns-csv")
    turns = inputs.table(spark, sf_dir, "conversations")
    writers.write_delimited(turns, path, options={"escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False})
    read = readers.read_csv(spark, path, infer_schema=True, multi_line=True, escape='"')
    return read.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")


def csv_multiline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, line breaks and quotes included, read back in byte ranges by a schema."""
    path = scratch_path(spark, "documents-csv")
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    writers.write_delimited(documents, path, options={"escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False})
    return readers.read_csv(spark, path, multi_line=True, escape='"', schema=documents.schema, options={"maxCharsPerColumn": -1})


def psv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_dataset(spark, "psv", _csv_of_orders(spark, sf_dir, "|"))


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-json")
    inputs.table(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).write.json(path)
    return readers.read_dataset(spark, "json", path)


_ROWS_PER_ARRAY = 100_000


def json_multiline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON arrays of one nation each, in as many files as keep an array's expected rows below a bound."""
    customers = inputs.table(spark, sf_dir, "customer")
    row = F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch_path(spark, "customers-json")
    shares = 1 + customers.count() // _ROWS_PER_ARRAY
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(shares)).alias("part")
    arrays = customers.groupBy("c_nationkey", part).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.write.partitionBy("c_nationkey", "part").text(path)
    return readers.read_dataset(spark, "json", path, multi_line=True).drop("part")


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table of the catalog, its files in the shared folder."""
    path = scratch_path(spark, "orders-table")
    name = path.rpartition("/")[2].replace("-", "_")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tallymark LOCATION '{path}-database'")
    _orders(spark, sf_dir).write.option("path", path).saveAsTable(f"tallymark.{name}")
    return readers.read_dataset(spark, "hive", database="tallymark", table=name)


def appended_psv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversion twice, the second time appending."""
    out = scratch_path(spark, "orders-psv")
    for append in (False, True):
        convert.convert(spark, convert.Conversion("csv_to_psv", _csv_of_orders(spark, sf_dir), out, append=append))
    return readers.read_psv(spark, out)


def conversion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two conversions of one list, their input given once for both."""
    outs = [scratch_path(spark, f"orders-{n}") for n in range(2)]
    specs = [{"kind": "csv_to_psv", "input_path": "/nowhere", "output_path": out, "delimiter": d} for out, d in zip(outs, (",", ";"))]
    report = convert.convert_all(spark, specs, input_path=_csv_of_orders(spark, sf_dir))
    rows = [(r["conversion"], r["rows_processed"], r["output_format"], r["status"]) for r in report]
    return spark.createDataFrame(rows, "conversion string, rows_processed long, output_format string, status string")


def xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parts-xml")
    inputs.table(spark, sf_dir, "part").write.option("rowTag", "part").xml(path)
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return readers.read_dataset(spark, "xml", path, row_tag="part", schema=schema)


def episodic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "suppliers-xml")
    inputs.table(spark, sf_dir, "supplier").write.option("rowTag", "record").xml(path)
    return readers.read_dataset(spark, "episodic", path)


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_dataset(spark, "parquet", f"{sf_dir}/lineitem.parquet")


def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as Parquet by status and read for one status only."""
    path = scratch_path(spark, "orders-parquet")
    _orders(spark, sf_dir).write.partitionBy("o_orderstatus").parquet(path)
    return readers.read_dataset(spark, "parquet", path, partition_filter="o_orderstatus = 'P'")


def _lines_file(spark: SparkSession, rows: DataFrame, line: Column, name: str) -> str:
    path = scratch_path(spark, name)
    rows.select(line.alias("value")).write.text(path)
    return path


def _customer_line() -> Column:
    return F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.rpad("c_name", 20, " "), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.lpad(F.col("c_acctbal").cast("string"), 12, " "), F.rpad("c_mktsegment", 12, " "),
    )


def fixed_length_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines_file(spark, inputs.table(spark, sf_dir, "customer"), _customer_line(), "customers-fixed")
    fields = {"c_custkey": (1, 10), "c_name": (11, 20), "c_nationkey": (31, 2), "c_acctbal": (33, 12), "c_mktsegment": (45, 12)}
    return readers.read_dataset(spark, "fixedlength", path, fields=fields)


def fixed_width_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines_file(spark, inputs.table(spark, sf_dir, "customer"), _customer_line(), "customers-fixed")
    fields = {"c_custkey": (1, 10), "c_name": (11, 30), "c_nationkey": (31, 32), "c_acctbal": (33, 44), "c_mktsegment": (45, 56)}
    return readers.read_dataset(spark, "fixedwidth", path, fields=fields)


_CUSTOMER_FIELDS = [
    {"name": "c_custkey", "start": 0, "length": 10, "type": "int"},
    {"name": "c_name", "start": 10, "length": 20},
    {"name": "c_nationkey", "start": 30, "length": 2, "type": "int"},
    {"name": "c_acctbal", "start": 32, "length": 12, "type": "double"},
    {"name": "c_mktsegment", "start": 44, "length": 12, "type": "string"},
    {"name": "c_comment", "start": 90, "length": 5},
]


def fixed_width_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines_file(spark, inputs.table(spark, sf_dir, "customer"), _customer_line(), "customers-fixed")
    out = scratch_path(spark, "customers-csv")
    convert.convert(spark, convert.Conversion("fixed_width_to_csv", path, out, params={"fields": _CUSTOMER_FIELDS}))
    return readers.read_csv(spark, out)


def record_types_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as header records and customers as details in the same files."""
    customers = inputs.table(spark, sf_dir, "customer").select(F.concat(F.lit("D01"), _customer_line()).alias("value"))
    nations = inputs.table(spark, sf_dir, "nation").select(F.concat(F.lit("H01"), F.col("n_name")).alias("value"))
    path = scratch_path(spark, "mixed-fixed")
    customers.unionAll(nations).write.text(path)
    fields = [{"name": "record_type", "start": 0, "length": 3}] + [{**f, "start": f["start"] + 3} for f in _CUSTOMER_FIELDS]
    return readers.read_record_types(spark, path, {"D": fields}, data_record_types=["D"])["D"]


def record_types_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders in one delimited file; orders come back with their customer."""
    customers = inputs.table(spark, sf_dir, "customer").select(F.concat_ws("|", F.lit("CUSTOMER"), "c_custkey", "c_name").alias("value"))
    orders = _orders(spark, sf_dir).select(F.concat_ws("|", F.lit("ORDER"), "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    path = scratch_path(spark, "mixed-delimited")
    customers.unionAll(orders).write.text(path)
    tables = readers.read_record_types(
        spark, path, {"CUSTOMER": ["customer_id", "name"], "ORDER": ["order_id", "customer_id", "status", "note"]}, separator="|"
    )
    return tables["ORDER"].join(tables["CUSTOMER"], "customer_id", "left_outer")


def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("~|~", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    path = _lines_file(spark, inputs.table(spark, sf_dir, "part"), line, "parts-lines")
    return readers.read_dataset(spark, "lines", path, fields=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "p_note"], separator="~|~")


_ORDER_RECORD = [
    {"name": "o_orderpriority", "start": 0, "length": 15},
    {"name": "o_orderkey", "start": 15, "length": 8, "type": "binary"},
    {"name": "o_totalprice", "start": 23, "length": 6, "type": "packed", "scale": 2},
    {"name": "balance", "start": 29, "length": 9, "type": "zoned", "scale": 2},
    {"name": "mirror_key", "start": 38, "length": 8, "type": "binary"},
]


def _ebcdic_file(spark: SparkSession, sf_dir: str) -> str:
    """Orders as EBCDIC records; the text sink's line feed is the last byte of each record."""
    o = _orders(spark, sf_dir)
    cents = F.round(F.col("o_totalprice") * 100).cast("decimal(11,0)").cast("string")
    negative = F.col("o_orderstatus") == "F"
    digits = F.lpad(cents, 9, "0")
    zoned = F.concat(
        F.regexp_replace(F.substring(digits, 1, 8), "(.)", "F$1"), F.when(negative, "D").otherwise("C"), F.substring(digits, 9, 1)
    )
    with layouts.java_charsets(spark):
        record = F.concat(
            F.encode(F.rpad("o_orderpriority", 15, " "), "IBM1047"),
            F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0")),
            F.unhex(F.lpad(F.concat(cents, F.when(negative, "D").otherwise("C")), 12, "0")),
            F.unhex(zoned),
            F.unhex(F.lpad(F.hex(-1 - F.col("o_orderkey")), 16, "0")),
        )
        path = scratch_path(spark, "orders-ebcdic")
        o.select(record.cast("string").alias("value")).write.text(path)
    return path


def ebcdic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _ebcdic_file(spark, sf_dir)
    read = readers.read_dataset(spark, "ebcdic", path, fields=_ORDER_RECORD, record_length=47)
    return read.withColumns({c: F.col(c).cast("double") for c in ("o_totalprice", "balance")})


def ebcdic_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "orders-csv")
    params = {"fields": _ORDER_RECORD[:2], "record_length": 47}
    convert.convert(spark, convert.Conversion("ebcdic_to_csv", _ebcdic_file(spark, sf_dir), out, delimiter="|", params=params))
    return readers.read_psv(spark, out)


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the catalog, read through a query with a parameter."""
    inputs.table(spark, sf_dir, "orders").createOrReplaceTempView("tallymark_orders")
    return readers.read_dataset(
        spark, "hql", query="SELECT * FROM tallymark_orders WHERE o_totalprice > :least", args={"least": 100000}
    )


def csv_to_psv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "orders-psv")
    convert.convert(spark, convert.Conversion("csv_to_psv", _csv_of_orders(spark, sf_dir), out))
    return readers.read_psv(spark, out)


def json_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an array of line prices, written as JSON, exploded into CSV rows."""
    lines = inputs.table(spark, sf_dir, "events").select(
        "event_id", F.struct("user_id", "event_type").alias("who"), F.array(F.col("value"), F.col("value") + 1).alias("readings")
    )
    path, out = scratch_path(spark, "events-json"), scratch_path(spark, "events-csv")
    lines.write.json(path)
    convert.convert(spark, convert.Conversion("json_to_csv", path, out, params={"multi_line": False}))
    return readers.read_csv(spark, out)


def xml_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = scratch_path(spark, "parts-xml"), scratch_path(spark, "parts-csv")
    inputs.table(spark, sf_dir, "part").write.option("rowTag", "part").xml(path)
    params = {"row_tag": "part", "schema": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"}
    convert.convert(spark, convert.Conversion("xml_to_csv", path, out, params=params))
    return readers.read_csv(spark, out)


def _episodes(spark: SparkSession, sf_dir: str, id_name: str = "episode_id") -> str:
    """Documents as JSON episodes with an array of their lines."""
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), F.length(line).alias("n_chars"))
    )
    path = scratch_path(spark, "episodes-json")
    documents = inputs.table(spark, sf_dir, "documents")
    documents.select(F.col("doc_id").alias(id_name), "lang", lines.alias("lines")).write.json(path)
    return path


def episodic_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child table of lines."""
    out = scratch_path(spark, "episodes-csv")
    convert.convert(spark, convert.Conversion("episodic_to_csv", _episodes(spark, sf_dir), out, params={"multi_line": False}))
    return readers.read_csv(spark, f"{out}_lines_items")


def episodic_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "episodes-csv")
    convert.convert(spark, convert.Conversion("episodic_to_csv", _episodes(spark, sf_dir), out, params={"multi_line": False}))
    return readers.read_csv(spark, out)


def episodic_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes without an id: the lines of the child table counted per parent, joined by the ids that were made for them."""
    out = scratch_path(spark, "episodes-csv")
    episodes = _episodes(spark, sf_dir, "doc_id")
    convert.convert(spark, convert.Conversion("episodic_to_csv", episodes, out, params={"multi_line": False}))
    lines = readers.read_csv(spark, f"{out}_lines_items").groupBy("episode_id").agg(F.count("*").alias("n_lines"))
    parents = readers.read_csv(spark, out)
    return parents.join(lines, "episode_id", "left_outer").select("doc_id", "lang", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversion reports, observed while it writes."""
    out = scratch_path(spark, "orders-psv")
    report = convert.convert(spark, convert.Conversion("csv_to_psv", _csv_of_orders(spark, sf_dir), out))
    rows = [(r["conversion"], r["rows_processed"], r["columns_processed"], r["output_format"], r["status"]) for r in report]
    return spark.createDataFrame(rows, "conversion string, rows_processed long, columns_processed long, output_format string, status string")


_ORDERS_TEXT = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders"""

_CUSTOMER_TEXT = """SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS c_custkey, rpad(c_name, 20, ' ') AS c_name,
       lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS c_nationkey, lpad(CAST(c_acctbal AS VARCHAR), 12, ' ') AS c_acctbal,
       rpad(c_mktsegment, 12, ' ') AS c_mktsegment FROM customer"""

QUERIES = {
    "csv_scan": (csv_scan, _ORDERS_TEXT),
    "csv_scan_with_schema": (csv_scan_with_schema, "SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders"),
    "csv_scan_inferred": (csv_scan_inferred, "SELECT conv_id, turn, role, text FROM conversations"),
    "csv_multiline_scan": (csv_multiline_scan, "SELECT doc_id, text, lang, source, n_chars FROM documents"),
    "psv_scan": (psv_scan, _ORDERS_TEXT),
    "json_scan": (json_scan, "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events"),
    "json_multiline_scan": (json_multiline_scan, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer"),
    "table_scan": (table_scan, "SELECT * FROM orders"),
    "appended_psv": (appended_psv, f"{_ORDERS_TEXT} UNION ALL {_ORDERS_TEXT}"),
    "conversion_list": (conversion_list, """SELECT 'csv_to_psv' AS conversion, count(*) AS rows_processed, f AS output_format, 'success' AS status
FROM orders, (SELECT unnest(['PSV', 'CSV']) AS f) GROUP BY f"""),
    "xml_scan": (xml_scan, "SELECT * FROM part"),
    "episodic_scan": (episodic_scan, "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"),
    "parquet_scan": (parquet_scan, "SELECT * FROM lineitem"),
    "partitioned_scan": (partitioned_scan, "SELECT * FROM orders WHERE o_orderstatus = 'P'"),
    "fixed_length_scan": (fixed_length_scan, _CUSTOMER_TEXT),
    "fixed_width_scan": (fixed_width_scan, _CUSTOMER_TEXT),
    "fixed_width_to_csv": (fixed_width_to_csv, """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment,
       CAST(NULL AS VARCHAR) AS c_comment FROM customer"""),
    "record_types_fixed_width": (record_types_fixed_width, """SELECT 'D01' AS record_type, CAST(c_custkey AS INTEGER) AS c_custkey, c_name,
       c_nationkey, c_acctbal, c_mktsegment, '' AS c_comment FROM customer"""),
    "record_types_delimited": (record_types_delimited, """SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
       CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS note, c_name AS name
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""),
    "delimited_lines": (delimited_lines, """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice, CAST(NULL AS VARCHAR) AS p_note FROM part"""),
    "ebcdic_scan": (ebcdic_scan, """SELECT o_orderpriority, o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS balance,
       -1 - o_orderkey AS mirror_key FROM orders"""),
    "ebcdic_to_csv": (ebcdic_to_csv, "SELECT o_orderpriority, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders"),
    "catalog_scan": (catalog_scan, "SELECT * FROM orders WHERE o_totalprice > 100000"),
    "csv_to_psv": (csv_to_psv, _ORDERS_TEXT),
    "json_to_csv": (json_to_csv, """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(unnest([value, value + 1]) AS VARCHAR) AS readings,
       event_type AS who_event_type, CAST(user_id AS VARCHAR) AS who_user_id FROM events"""),
    "xml_to_csv": (xml_to_csv, """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part"""),
    "episodic_to_csv": (episodic_to_csv, """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS episode_id, CAST(unnest(range(len(parts))) AS VARCHAR) AS lines_item_line_no,
       CAST(unnest(list_transform(parts, lambda x: length(x))) AS VARCHAR) AS lines_item_n_chars FROM l"""),
    "episodic_generated_ids": (episodic_generated_ids, """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, coalesce(len(string_split(text, chr(10))), 0) AS n_lines
FROM documents"""),
    "episodic_parents": (episodic_parents, "SELECT CAST(doc_id AS VARCHAR) AS episode_id, lang FROM documents"),
    "conversion_report": (conversion_report, """SELECT 'csv_to_psv' AS conversion, count(*) AS rows_processed, CAST(6 AS BIGINT) AS columns_processed,
       'PSV' AS output_format, 'success' AS status FROM orders"""),
}
