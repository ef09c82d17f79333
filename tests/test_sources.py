import json
import random

import pytest
from pyspark.sql import functions as F

from tallymark.sources import convert, layouts, readers, writers
from tallymark.operators.attribution import missing_parents

PEOPLE = [("1", "Ann", "30", "Oslo"), ("2", "Ben", "41", "Bonn"), ("3", "Cy", "25", "Rome")]


@pytest.fixture
def folder(tmp_path):
    def write(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.write_text(text, encoding=encoding)
        return str(path)

    return write


def _csv(delimiter=","):
    return "\n".join(delimiter.join(r) for r in [("id", "name", "age", "city"), *PEOPLE]) + "\n"


@pytest.mark.parametrize(("fmt", "delimiter"), [("csv", ","), ("psv", "|")])
def test_delimited_is_all_text(spark, folder, fmt, delimiter):
    df = readers.read_dataset(spark, fmt, folder("p.txt", _csv(delimiter)))
    assert {t for _, t in df.dtypes} == {"string"}
    assert sorted(tuple(r) for r in df.collect()) == PEOPLE


def test_csv_options(spark, folder):
    path = folder("p.csv", "a;d\n1;31.01.2024\nNA;'x;y'\n", "iso-8859-1")
    df = readers.read_csv(spark, path, delimiter=";", encoding="iso-8859-1", null_value="NA", quote="'", infer_schema=True)
    assert df.dtypes[0] == ("a", "int")
    typed = readers.read_csv(spark, path, delimiter=";", schema="a int, d date", null_value="NA", date_format="dd.MM.yyyy", quote="'")
    assert [(r.a, str(r.d)) for r in typed.collect()] == [(1, "2024-01-31"), (None, "None")]


def test_json_array_on_one_line(spark, folder):
    path = folder("p.json", json.dumps([dict(zip(("id", "name", "age", "city"), p)) for p in PEOPLE]))
    assert readers.read_dataset(spark, "json", path, multi_line=True).count() == 3


def test_xml_row_tags(spark, folder):
    rows = "".join(f"<person><id>{p[0]}</id><name>{p[1]}</name></person>" for p in PEOPLE)
    path = folder("p.xml", f"<data>{rows}</data>")
    assert readers.read_dataset(spark, "xml", path, row_tag="person").count() == 3
    assert readers.read_episodic(spark, path, row_tag="person", schema="id int, name string").first().id == 1


XML_SCHEMA = "_n int, id int, name string, tags array<string>, price double"


def _people(n):
    return "".join(
        f'  <person n="{i}">\n<id>{i}</id><name> A &lt;{i}&gt; \u00e9 </name>{"<tags>x</tags>" * (i % 3)}<price>{i / 4}</price></person>\n' for i in range(n))


def test_large_xml_file_is_read_by_several_tasks(spark, folder):
    path = folder("p.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<data>\n{_people(4000)}<personal><id>7</id></personal></data>')
    whole = spark.read.option("rowTag", "person").schema(XML_SCHEMA).xml(path).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10007")
    try:
        df = readers.read_xml(spark, path, row_tag="person", schema=XML_SCHEMA)
        assert df.rdd.getNumPartitions() > 20
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, whole)) and len(whole) == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", [
    "<data><!-- </person><person> -->{}</data>",
    "<data>{}<person n='5'><id>1</id><name><![CDATA[</person>]]></name></person></data>",
    "<data>{}<person n='7'/><person><id>2</id></person ></data>",
    "<data><person><id>9</id><person><id>8</id></person></person>{}</data>",
    "<data><other><person><id>3</id></person></other>{}</data>",
    "<data></data>",
])
@pytest.mark.parametrize("mode", ["PERMISSIVE", "FAILFAST"])
def test_odd_xml_reads_as_spark_reads_it(spark, folder, text, mode):
    path = folder("p.xml", text.format(_people(5)))
    want = spark.read.option("rowTag", "person").option("mode", mode).schema(XML_SCHEMA).xml(path)
    got = readers.read_xml(spark, path, row_tag="person", schema=XML_SCHEMA, mode=mode)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.dtypes == want.dtypes


def test_positional_layouts(spark, folder):
    path = folder("p.txt", "01Ann  \n02Ben  \n")
    length = readers.read_dataset(spark, "fixedlength", path, fields={"id": (1, 2), "name": (3, 5)})
    width = readers.read_dataset(spark, "fixedwidth", path, fields={"id": (1, 2), "name": (3, 7)})
    assert [tuple(r) for r in length.collect()] == [tuple(r) for r in width.collect()] == [("01", "Ann  "), ("02", "Ben  ")]


def test_typed_fixed_width(spark, folder):
    path = folder("p.txt", "000001Ann            Lee                 12.50     2024-01-31\n000002Ben\n")
    fields = [
        {"name": "EMPLOYEE_ID", "start": 0, "length": 6}, {"name": "FIRST_NAME", "start": 6, "length": 15},
        {"name": "LAST_NAME", "start": 21, "length": 20}, {"name": "SALARY", "start": 41, "length": 10, "type": "double"},
        {"name": "HIRE_DATE", "start": 51, "length": 10, "type": "date"},
    ]
    rows = [tuple(str(c) for c in r) for r in readers.read_typed_fixed_width(spark, path, fields).collect()]
    assert rows == [("000001", "Ann", "Lee", "12.5", "2024-01-31"), ("000002", "Ben", "", "None", "None")]


def test_record_types_fixed_width(spark, folder):
    path = folder("m.txt", "H0120230615HEADER\nD100001JOHN      DOE\nD100002JANE      SMITH\nT01000002\n")
    fields = [
        {"name": "record_type", "start": 0, "length": 2}, {"name": "customer_id", "start": 2, "length": 5, "type": "int"},
        {"name": "first_name", "start": 7, "length": 10}, {"name": "last_name", "start": 17, "length": 10},
    ]
    found = readers.read_record_types(spark, path, {"D": fields}, data_record_types=["D"])["D"]
    assert [tuple(r) for r in found.collect()] == [("D1", 1, "JOHN", "DOE"), ("D1", 2, "JANE", "SMITH")]
    bare = readers.read_record_types(spark, path, {"D": fields}, data_record_types=["D"], include_record_type=False)["D"]
    assert bare.columns == ["customer_id", "first_name", "last_name"]


EPISODES = """PATIENT|P1|John Doe|19800101|M
EPISODE|E1|P1|20230101|20230110|INPATIENT
DIAGNOSIS|D1|E1|J45|Asthma|PRIMARY
DIAGNOSIS|D2|E1|I10|Hypertension|SECONDARY
PATIENT|P2|Jane Smith|19900215|F
EPISODE|E2|P2|20230205|20230208|OUTPATIENT
EPISODE|E3|P9|20230205
"""
TYPES = {
    "PATIENT": ["patient_id", "name", "birth_date", "gender"],
    "EPISODE": ["episode_id", "patient_id", "start_date", "end_date", "type"],
    "DIAGNOSIS": ["diagnosis_id", "episode_id", "code", "description", "type"],
}


def test_record_types_delimited(spark, folder):
    tables = readers.read_record_types(spark, folder("e.epi", EPISODES), TYPES, separator="|")
    assert {n: t.count() for n, t in tables.items()} == {"PATIENT": 2, "EPISODE": 3, "DIAGNOSIS": 2}
    lost = missing_parents(tables["EPISODE"], tables["PATIENT"], {"patient_id": "patient_id"}).collect()
    assert [(r.episode_id, r.end_date) for r in lost] == [("E3", None)]


def test_ebcdic_round_trip(spark, tmp_path):
    def record(name, number, packed, zoned):
        return name.ljust(6).encode("cp037") + number.to_bytes(2, "big", signed=True) + bytes.fromhex(packed) + bytes.fromhex(zoned)

    path = tmp_path / "r.dat"
    path.write_bytes(record("ANN", -2, "12345D", "F1F2D3") + record("BEN", 300, "00100C", "F0F0C7"))
    fields = [
        {"name": "name", "start": 0, "length": 6}, {"name": "n", "start": 6, "length": 2, "type": "binary"},
        {"name": "p", "start": 8, "length": 3, "type": "packed", "scale": 2}, {"name": "z", "start": 11, "length": 3, "type": "zoned"},
    ]
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    df = readers.read_dataset(spark, "ebcdic", str(path), fields=fields, record_length=14, charset="IBM037")
    assert [tuple(str(c) for c in r) for r in df.collect()] == [("ANN", "-2", "-123.45", "-123"), ("BEN", "300", "1.00", "7")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before
    with pytest.raises(ValueError):
        layouts.decode_records(spark.createDataFrame([(b"x",)], "record binary"), [{"name": "a", "start": 0, "length": 1, "type": "odd"}])


def test_catalog_table(spark):
    spark.range(3).write.mode("overwrite").option("path", _new_path(spark)).saveAsTable("default.tallymark_probe")
    try:
        assert readers.read_dataset(spark, "hive", database="default", table="tallymark_probe").count() == 3
    finally:
        spark.sql("DROP TABLE default.tallymark_probe")


def _new_path(spark):
    from tallymark.session import scratch_path

    return scratch_path(spark, "probe")


def test_unknown_format_and_gated_arguments(spark):
    with pytest.raises(ValueError, match="unsupported format"):
        readers.read_dataset(spark, "excel", "x")
    options = readers.jdbc_options("h", 1433, "d", "u", "p", "t")
    assert options["url"] == "jdbc:sqlserver://h:1433;databaseName=d;encrypt=true;trustServerCertificate=true"
    with pytest.raises(ValueError, match="parallel read"):
        readers.read_jdbc(spark, hostname="h", port=1, database="d", username="u", password="p", table="t", num_partitions=4)
    with pytest.raises(TypeError):
        readers.read_dataset(spark, "bigquery", project_id="p", dataset="d")


def test_conversion_overrides_and_report(spark, folder, tmp_path):
    spec = {"kind": "csv_to_psv", "input_path": "/nowhere", "output_path": "/nowhere/out"}
    out = str(tmp_path / "out")
    report = convert.convert(spark, spec, input_path=folder("p.csv", _csv()), output_path=out)
    assert [(r["rows_processed"], r["columns_processed"], r["output_format"], r["status"]) for r in report] == [(3, 4, "PSV", "success")]
    assert readers.read_psv(spark, out).count() == 3
    convert.convert(spark, {**spec, "append": True}, input_path=folder("p.csv", _csv()), output_path=out)
    assert readers.read_psv(spark, out).count() == 6


def test_conversion_errors_are_reported(spark, folder):
    path = folder("p.csv", _csv())
    for spec in (
        {"kind": "csv_to_psv", "input_path": path, "output_path": path},
        {"kind": "xml_to_csv", "input_path": path, "output_path": path + "_out"},
        {"kind": "sorcery", "input_path": path, "output_path": path + "_out"},
    ):
        assert [r["status"] for r in convert.convert_all(spark, [spec])] == ["error"]


def test_json_with_two_arrays_needs_a_choice(spark, folder, tmp_path):
    path = folder("p.json", '{"id": 1, "a": [1, 2], "b": [3], "s": {"t": {"u": 5}}}\n')
    spec = {"kind": "json_to_csv", "input_path": path, "output_path": str(tmp_path / "o1"), "params": {"multi_line": False}}
    assert convert.convert(spark, spec)[0]["status"] == "error"
    spec |= {"output_path": str(tmp_path / "o2"), "params": {"multi_line": False, "explode": ["a"]}}
    assert convert.convert(spark, spec)[0]["status"] == "success"
    rows = readers.read_csv(spark, str(tmp_path / "o2"))
    assert sorted((r.a, r.b, r.s_t_u) for r in rows.collect()) == [("1", "[3]", "5"), ("2", "[3]", "5")]


def test_episodes_without_an_id_get_a_stable_one(spark, folder, tmp_path):
    path = folder("p.json", '{"n": 1, "v": [1, 2]}\n{"n": 1, "v": [1, 2]}\n{"n": 2, "v": []}\n')
    df = readers.read_json(spark, path)
    parent, children = convert.split_episodes(df, "episode_id")
    ids = {r.episode_id for r in parent.collect()}
    assert len(ids) == 3 and parent.columns == ["n", "episode_id"]
    found = children["v"].collect()
    assert len(found) == 4 and {r.episode_id for r in found} < ids


def test_typed_episodes_are_written_beside_each_other(spark, folder, tmp_path):
    out = str(tmp_path / "epi")
    params = {"file_format": "custom", "record_types": TYPES}
    report = convert.convert(spark, convert.Conversion("episodic_to_csv", folder("e.epi", EPISODES), out, params=params))
    assert {r["output_path"].rsplit("_", 1)[1]: r["rows_processed"] for r in report} == {"PATIENT": 2, "EPISODE": 3, "DIAGNOSIS": 2}


def test_schema_from_text():
    assert convert.schema_from_text("a int, b string") == convert.schema_from_text(
        '{"type":"struct","fields":[{"name":"a","type":"integer","nullable":true,"metadata":{}},{"name":"b","type":"string","nullable":true,"metadata":{}}]}'
    )


def test_report_tables(spark, tmp_path):
    for fmt in ("parquet", "json"):
        writers.write_report({"counts": spark.range(2)}, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(f"{tmp_path / fmt}/counts").count() == 2
    with pytest.raises(ValueError):
        writers.write_report({}, str(tmp_path), "html")


def test_lines_with_odd_separator(spark, folder):
    path = folder("l.txt", "a\\E.b\\E.c\nx\n")
    rows = readers.read_delimited_lines(spark, path, ["p", "q", "r"], separator="\\E.")
    assert [tuple(r) for r in rows.collect()] == [("a", "b", "c"), ("x", None, None)]


@pytest.mark.parametrize("output", ["{d}/in", "file:{d}/x/../in", "file://{d}/in/", "{d}/in/below", "{d}", "{r}/in"])
@pytest.mark.parametrize("source", ["{d}/in", "{d}/in/", "{d}/i*", "file:{d}/y/../in/*.csv"])
def test_an_input_is_never_lost(spark, tmp_path, source, output):
    import os

    names = {"d": str(tmp_path), "r": os.path.relpath(tmp_path)}
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.csv(f"{tmp_path}/in", header=True)
    report = convert.convert(spark, {"kind": "csv_to_psv", "input_path": source.format(**names), "output_path": output.format(**names)})
    assert [r["status"] for r in report] == ["error"]
    assert spark.read.csv(f"{tmp_path}/in", header=True).count() == 2


def test_a_conversion_beside_its_input_is_allowed(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, v string").write.csv(f"{tmp_path}/in", header=True)
    report = convert.convert(spark, {"kind": "csv_to_psv", "input_path": f"{tmp_path}/in", "output_path": f"{tmp_path}/in_psv"})
    assert [r["status"] for r in report] == ["success"]


def _texts(rnd, n, length):
    """Field texts with line ends, quotes and separators; some reach over several byte ranges."""
    return ["".join(rnd.choices(["a", "é", "b", "\n", "\n\n", '"', ",", "\\", " x"], k=rnd.choice([0, 1, 3, 20, length]))) for _ in range(n)]


def _quoted(text, escape):
    return '"' + (text.replace('"', '""') if escape == '"' else text.replace("\\", "\\\\").replace('"', '\\"')) + '"'


@pytest.mark.parametrize("escape", ['"', "\\"])
@pytest.mark.parametrize("end", ["\n", ""])
def test_multi_line_csv_in_byte_ranges(spark, folder, escape, end):
    rnd = random.Random(len(end))
    rows = [(str(i), t, f"n{i % 5}") for i, t in enumerate(_texts(rnd, 400, 3000))]
    lines = ["id,text,last", "", *[f"{i},{_quoted(t, escape)},{last}" for i, t, last in rows[:200]], " ", *[f"{i},{_quoted(t, escape)},{last}" for i, t, last in rows[200:]]]
    path = folder("quoted.csv", "\n".join(lines) + end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        found = sorted((tuple(r) for r in readers.read_csv(spark, path, multi_line=True, escape=escape).collect()), key=str)
        own = spark.read.csv(path, header=True, multiLine=True, escape=escape)
        assert found == sorted((tuple(r) for r in own.collect()), key=str) and len(found) == len(rows) + 1
        typed = readers.read_csv(spark, path, multi_line=True, escape=escape, schema="id long, text string, last string")
        assert typed.agg(F.sum("id")).first()[0] == sum(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_multi_line_csv_of_several_files(spark, tmp_path):
    """Headers of all files go, partition columns stay, files without records or with line ends of two characters are read."""
    for n, text in enumerate(['a,b\n1,"x\ny"\n', "a,b\n", 'a,b\r\n2,"p q"\r\n3,z\r\n', '"a",b\n4,"un""quoted"']):
        (tmp_path / f"p={n % 2}").mkdir(exist_ok=True)
        (tmp_path / f"p={n % 2}" / f"{n}.csv").write_text(text, newline="")
    found = readers.read_csv(spark, str(tmp_path), multi_line=True, escape='"').collect()
    assert sorted((r.a, r.b, r.p) for r in found) == [("1", "x\ny", 0), ("2", "p q", 0), ("3", "z", 0), ("4", 'un"quoted', 1)]
    bare = readers.read_csv(spark, str(tmp_path / "p=0"), multi_line=True, header=False, escape='"')
    assert bare.count() == 5 and bare.columns == ["_c0", "_c1"]


def test_row_ids_number_copies_only(spark):
    """Ids do not depend on the partitions, helper names do not clash, and only repeated rows have a number above 1."""
    rows = spark.range(25_000).selectExpr(
        "if(id % 4 = 0, -1, id) AS n", "if(id % 4 = 0 OR id = 7, null, array(id)) AS items", "'x' AS `_digest`", "'y' AS `_d`", "'z' AS `_copies`")
    first = convert.with_row_id(rows, "rid")
    again = {r.rid for r in convert.with_row_id(rows.repartition(5), "rid").collect()}
    found = first.collect()
    assert first.columns == [*rows.columns, "rid"] and {r.rid for r in found} == again and len(again) == 25_000
    numbers = sorted(int(r.rid.split("-")[1]) for r in found if r.n == -1)
    assert numbers == list(range(1, 6251)) and {r.rid.split("-")[1] for r in found if r.n != -1} == {"1"}
    assert {(r._2, r._3, r._4) for r in first.select(F.col("n"), F.col("_digest").alias("_2"), F.col("_d").alias("_3"), F.col("_copies").alias("_4")).collect()} == {("x", "y", "z")}
    parent, children = convert.split_episodes(rows, "rid")
    assert parent.count() == 25_000 and children["items"].count() == 25_000 - 6250 - 1
    assert convert.with_row_id(rows.limit(0), "rid").count() == 0
