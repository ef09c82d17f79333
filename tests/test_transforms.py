import pytest
from pyspark.sql import functions as F

from tallymark.operators import transforms as t
from tallymark.plans.chain import Step, register, run_chain

PERSON = "id int, name string, amount double"


@pytest.fixture
def people(spark):
    source = [(1, "John", 100.0), (2, "Alice", 200.5), (3, "Bob", 300.0)]
    target = [(1, "John", 100.0), (2, "Alice", 200.5), (3, "Robert", 350.25)]
    return spark.createDataFrame(source, PERSON), spark.createDataFrame(target, PERSON)


def test_chain_transforms_each_side_from_its_own_data(people):
    done = run_chain(*people, [Step("upper_column", {"column": "name"}, "source"), Step("upper_column", {"column": "name"}, "target")])
    assert [r.name for r in done.source.orderBy("id").collect()] == ["JOHN", "ALICE", "BOB"]
    assert [r.name for r in done.target.orderBy("id").collect()] == ["JOHN", "ALICE", "ROBERT"]
    assert [s["status"] for s in done.steps] == ["success", "success"]


def test_failed_step_is_recorded_and_skipped(people):
    done = run_chain(*people, [
        Step("no_such_transform"),
        Step("upper_column", {"column": "absent"}),
        Step("add_constant", {"column": "c", "value": 1}),
        Step("upper_column", {"column": "name"}, "nowhere"),
    ])
    assert [s["status"] for s in done.steps] == ["error", "error", "success", "error"]
    assert "c" in done.source.columns and "c" in done.target.columns


def test_registered_and_plain_functions(people):
    register("double_amount", lambda df: df.withColumn("amount", F.col("amount") * 2))
    done = run_chain(*people, [Step("double_amount", side="source"), Step(lambda df: df.filter("id > 1"), side="target")])
    assert done.source.agg(F.sum("amount")).first()[0] == 1201.0
    assert done.target.count() == 2


def test_filter_without_usable_condition_keeps_all(people):
    assert t.filter_rows(people[0], [{"column": "id"}, {"column": "x", "operator": "==", "value": 1}]).count() == 3
    assert t.filter_rows(people[0], []).count() == 3


@pytest.mark.parametrize(("operator", "value", "ids"), [
    ("==", 2, [2]), ("!=", 2, [1, 3]), (">", 1, [2, 3]), (">=", 2, [2, 3]), ("<", 2, [1]), ("<=", 2, [1, 2]),
    ("in", [1, 3], [1, 3]), ("not in", [1, 3], [2]), ("in", 1, [1, 2, 3]),
])
def test_operators(people, operator, value, ids):
    kept = t.filter_rows(people[0], [{"column": "id", "operator": operator, "value": value}])
    assert sorted(r.id for r in kept.collect()) == ids


def test_filter_reaches_the_scan(table):
    orders = t.filter_rows(table("orders"), [{"column": "o_totalprice", "operator": ">", "value": 1000}]).select("o_orderkey")
    plan = orders._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("1", "2024-02-30"), ("x", "2024-02-29")], "n string, d string")
    rows = t.cast_columns(df, {"n": "int", "d": "date", "absent": "int", "n2": "uuid"}).collect()
    assert [(r.n, str(r.d)) for r in rows] == [(1, "None"), (None, "2024-02-29")]


def test_align_keeps_exact_types(spark):
    source = spark.createDataFrame([(1, "1.50")], "a long, b string").withColumn("b", F.col("b").cast("decimal(10,2)"))
    target = spark.createDataFrame([("7", "x")], "a string, b string")
    assert t.align_types(source, target).dtypes == [("a", "bigint"), ("b", "decimal(10,2)")]


def test_explode_keeps_empty_arrays_and_refuses_two(spark):
    df = spark.createDataFrame([(1, [1, 2], ["x"]), (2, [], None)], "id int, a array<int>, b array<string>")
    assert sorted((r.id, r.a) for r in t.explode_arrays(df.drop("b")).collect()) == [(1, 1), (1, 2), (2, None)]
    with pytest.raises(ValueError):
        t.explode_arrays(df)
    assert t.explode_arrays(df, ["a", "b"]).count() == 3


def test_decode_skips_empty_descriptions_and_null_codes(spark):
    df = spark.createDataFrame([(1, "A"), (2, "I"), (3, None), (4, "Z"), (5, "E")], "id int, status string")
    codes = spark.createDataFrame([("A", "Active"), ("I", "old"), ("I", "Inactive"), ("E", ""), (None, "none")], "Code string, Description string")
    codes = codes.withColumn("n", F.monotonically_increasing_id())
    found = {r.id: r.status_decoded for r in t.decode_codes(df, codes, "status", F.col("n")).collect()}
    assert found == {1: "Active", 2: "Inactive", 3: None, 4: None, 5: None}


def test_group_aggregate(people):
    assert t.group_aggregate(people[0], "amount", "max", ["name"]).columns == ["name", "max_amount"]
    with pytest.raises(ValueError):
        t.group_aggregate(people[0], "amount", "median", ["name"])
