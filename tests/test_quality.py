import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallymark.operators import keys, rules, schema
from tallymark.operators.rules import Rule, normalise_rules


def test_rule_forms_agree():
    by_column = {"id": [{"rule": "not_null"}], "name": [{"rule": "regex", "pattern": "^a"}]}
    as_list = [{"column": "id", "rule": "not_null"}, {"column": "name", "rule": "regex", "pattern": "^a"}]
    as_yaml = {"rules": [
        {"column": "id", "validation": {"type": "not_null"}},
        {"column": "name", "validation": {"type": "regex", "pattern": "^a"}},
    ]}
    by_rule = {"not_null": ["id"], "regex": {"name": "^a"}}
    want = [Rule("id", "not_null"), Rule("name", "regex", pattern="^a")]
    assert all(normalise_rules(form) == want for form in (by_column, as_list, as_yaml, by_rule))


def test_range_forms():
    want = [Rule("age", "range", minimum=18.0, maximum=65.0)]
    assert normalise_rules([{"column": "age", "validation": {"type": "range", "threshold": "18-65"}}]) == want
    assert normalise_rules([{"column": "age", "rule_type": "range", "min": 18, "max": 65}]) == want
    assert normalise_rules({"threshold": {"age": {"min": 18, "max": 65}}}) == want


def _status(df, given):
    return [(r.rule, r.status, r.message) for r in rules.evaluate_rules(df, given).orderBy("position").collect()]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "x string")
    found = _status(empty, {"x": [{"rule": r} for r in ("not_null", "null", "threshold", "uniqueness")]})
    assert [s for _, s, _ in found] == ["PASS"] * 4


def test_null_counts_once_in_uniqueness(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "x string")
    row = rules.evaluate_rules(df, {"x": [{"rule": "uniqueness", "threshold": 0.75}]}).first()
    assert (row.status, row.ratio) == ("PASS", 0.75)


def test_nulls_do_not_violate_value_rules(spark):
    df = spark.createDataFrame([("1",), (None,), ("2x",)], "x string")
    given = [
        {"column": "x", "rule": "regex", "pattern": r"\d"},
        {"column": "x", "rule": "range", "min": 0, "max": 9},
        {"column": "x", "rule": "custom", "condition": "<> 'z'"},
    ]
    assert [s for _, s, _ in _status(df, given)] == ["PASS", "FAIL", "PASS"]


def test_unknown_rules_are_errors(spark):
    df = spark.createDataFrame([("a",)], "x string")
    given = {"x": [{"rule": "sparkle"}, {"rule": "pattern", "pattern": "phone"}, {"rule": "regex", "pattern": "(["}]}
    assert [s for _, s, _ in _status(df, given)] == ["ERROR", "ERROR", "FAIL"]
    assert _status(df, {"y": [{"rule": "not_null"}]}) == [("column_exists", "FAIL", "Column does not exist in dataframe")]


def test_dotted_column(spark):
    df = spark.createDataFrame([(("12",),), (("x",),)], "nested struct<field:string>")
    row = rules.evaluate_rules(df, [{"column": "nested.field", "rule": "regex", "pattern": r"^\d+$"}]).first()
    assert (row.status, row.violations) == ("FAIL", 1)


def test_no_rules(spark):
    found = rules.evaluate_rules(spark.createDataFrame([("a",)], "x string"), None)
    assert found.count() == 0 and rules.rule_verdict(found).first().status == "NULL"


def test_find_key_single_combination_and_none(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "a"), (2, 1, "b"), (2, 2, "c")], "a int, b int, c string")
    assert keys.find_key(df) == ("a", "b")
    assert keys.find_key(df.select("a", "c")) is None
    assert keys.find_key(df.withColumn("d", df.a * 10 + df.b)) == ("d",)
    assert keys.find_key(df.select("a", "b"), max_columns=1) is None


def test_find_key_needs_three_columns(spark):
    rows = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    assert keys.find_key(spark.createDataFrame(rows, "a int, b int, c int")) == ("a", "b", "c")


def _first_key(rows, width, max_columns=3):
    for k in range(1, max_columns + 1):
        for c in combinations(range(width), k):
            if all(r[i] is not None for r in rows for i in c) and len({tuple(r[i] for i in c) for r in rows}) == len(rows):
                return tuple(f"c{i}" for i in c)
    return None


def _keyed(spark, rows, width):
    return spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(width)))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("sampled", [20_000, 7])
def test_find_key_against_brute_force(spark, monkeypatch, seed, sampled):
    """Samples that refute everything, and samples so small that the checks over all rows and their evidence decide."""
    monkeypatch.setattr(keys, "_SAMPLED_ROWS", sampled)
    monkeypatch.setattr(keys, "_SAMPLED_VALUES", 2)
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 2, 5, 9, 30, 60]) for _ in range(6)]
    rows = [tuple(None if i == seed and rnd.random() < 0.01 else rnd.randrange(n) for i, n in enumerate(sizes)) for _ in range(40 + 10 * seed)]
    if seed % 2:
        rows.append(rows[0])
    assert keys.find_key(_keyed(spark, rows, 6)) == _first_key(rows, 6)


def test_find_key_of_forty_columns(spark):
    """10,700 combinations, one column that repeats once only, a hot value in a third of the rows: a few passes."""
    n, width = 9_000, 40
    columns = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2 + i % 12)).cast("int").alias(f"c{i}") for i in range(width)]
    columns[17] = F.when(F.col("id") % 3 == 0, 0).otherwise(F.floor(F.col("id") / 30) + 1).cast("int").alias("c17")
    columns[25] = F.when(F.col("id") == n - 1, 0).otherwise(F.col("id")).cast("int").alias("c25")
    columns[31] = (F.col("id") % 30).cast("int").alias("c31")
    columns[38] = F.floor(F.col("id") / 30).cast("int").alias("c38")
    df = spark.range(n).select(*columns)
    rows = [tuple(r) for r in df.collect()]
    spark.sparkContext.setJobGroup("forty", "forty")
    assert keys.find_key(df) == _first_key(rows, width)
    three = df.drop("c25", "c38")
    assert keys.find_key(three) is None
    spark.sparkContext.setJobGroup("after", "after")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forty")) <= 40


def test_find_key_of_repeated_rows_and_empty_tables(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) AS a", "if(id % 3 = 0, 0, id % 100) AS `b.c`")
    assert keys.find_key(df) is None
    assert keys.find_key(df.limit(0)) == ("a",)
    assert keys.find_key(df.select()) is None


def test_validate_keys(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "id int, v string")
    assert keys.validate_keys(df, ["id"]) == (("id",), True)
    assert keys.validate_keys(df, ["v"]) == (("id",), False)
    assert keys.validate_keys(df, ["zz"]) == (("id",), False)


def test_classify_keys(spark):
    rows = [(i, float(i), f"n{i}" if i else None, i % 3, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "pk long, price double, name string, fk int, flag boolean")
    found = {r.column_name: r.key_class for r in keys.classify_keys(df).collect()}
    assert found == {"pk": "primary", "price": "candidate", "name": "candidate", "fk": "foreign"}


def test_schema_ignores_order_and_nullability(spark):
    a = spark.createDataFrame([(1, "x")], "a int not null, b string")
    b = spark.createDataFrame([("x", 1)], "b string, a int")
    assert schema.schemas_match(a, b)
    assert not schema.schemas_match(a, b.withColumn("a", b.a.cast("long")))


@pytest.mark.parametrize("present", [True, False])
def test_add_missing_columns(spark, present):
    df = spark.createDataFrame([(1,)], "a int")
    name = "a" if present else "z"
    assert schema.add_missing_columns(df, [(name, "string")]).dtypes == ([("a", "int")] if present else [("a", "int"), ("z", "string")])
