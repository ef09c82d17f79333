import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark.operators import diff, keys, profile
from tallymark.operators.copies import unroll_copies
from tallymark.plans.reconcile import reconcile

EMPLOYEE = "ID int, Name string, Department string, Salary int, Status string"


@pytest.fixture
def employees(spark):
    source = [
        (1, "Ann", "IT", 100, "A"), (2, "Ben", "HR", 200, "A"), (3, "Cy", "IT", 300, "I"),
        (4, "Di", "HR", 400, "A"), (5, "Ed", "IT", 500, "P"),
    ]
    target = [
        (1, "Ann", "IT", 100, "A"), (2, "Bert", "HR", 250, "A"), (3, "Cy", "IT", 300, "A"),
        (6, "Flo", "HR", 600, "A"), (7, "Gus", "IT", 700, "I"),
    ]
    return spark.createDataFrame(source, EMPLOYEE), spark.createDataFrame(target, EMPLOYEE)


@pytest.mark.parametrize("pairing", diff.PAIRINGS)
def test_employee_pair(employees, pairing):
    rows = diff.row_diff(diff.pair_rows(*employees, ["ID"], pairing=pairing)).cache()
    assert {r.status: r.row_count for r in diff.diff_summary(rows).collect()} == {
        "missing_in_target": 2, "missing_in_source": 2, "values_differ": 2,
    }
    cells = {(r.ID, r.column): (r.source_value, r.target_value) for r in diff.cell_diff(rows).collect() if r.column}
    assert cells == {(2, "Name"): ("Ben", "Bert"), (2, "Salary"): ("200", "250"), (3, "Status"): ("I", "A")}


def test_equal_counts_still_compare_keys(employees):
    totals = profile.overlap_summary(*employees, ["ID"]).first()
    assert (totals.source_count, totals.target_count) == (5, 5)
    assert (totals.matching_records, totals.source_only, totals.target_only) == (3, 2, 2)


def test_reconcile_employees(employees):
    done = reconcile(*employees, ["ID"])
    status = {r.validation_type: r.status for r in done.summary.collect()}
    assert status == {
        "Count Validation": "PASS", "Schema Validation": "PASS", "Data Validation": "FAIL", "Null Check": "PASS",
        "Duplicate Check": "PASS", "Rule Validation": "NULL", "Overall Status": "FAIL",
    }
    failed = {r.column_name: r.total_records - r.pass_count for r in done.column_stats.filter("status = 'FAIL'").collect()}
    assert failed == {"Name": 1, "Salary": 1, "Status": 1}
    done.release()


def test_null_modes(spark):
    source = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "d")], "k int, v string")
    target = spark.createDataFrame([(1, None), (2, "b"), (3, None), (4, "x")], "k int, v string")
    passed = {
        mode: diff.column_stats(diff.pair_rows(source, target, ["k"], null_mode=mode)).first().pass_count
        for mode in ("safe", "sql")
    }
    assert passed == {"safe": 1, "sql": 3}


@pytest.mark.parametrize("pairing", diff.PAIRINGS)
def test_null_keys_match(spark, pairing):
    source = spark.createDataFrame([(None, 1, "a"), (2, None, "b")], "k int, j int, v string")
    target = spark.createDataFrame([(None, 1, "x"), (2, None, "b")], "k int, j int, v string")
    rows = diff.row_diff(diff.pair_rows(source, target, ["k", "j"], pairing=pairing)).collect()
    assert [(r.k, r.j, r.status) for r in rows] == [(None, 1, "values_differ")]


def test_nested_and_map_cells(spark):
    schema = "k int, m map<string,int>, a array<int>, s struct<x:int,m:map<string,int>>"
    source = spark.createDataFrame([(1, {"a": 1, "b": 2}, [1, 2], (1, {"q": 1})), (2, {"a": 1}, [1], (1, None))], schema)
    target = spark.createDataFrame([(1, {"b": 2, "a": 1}, [1, 2], (1, {"q": 1})), (2, {"a": 2}, [1, 3], (2, None))], schema)
    for pairing in ("unique", "first"):
        rows = diff.row_diff(diff.pair_rows(source, target, ["k"], pairing=pairing)).collect()
        assert [(r.k, sorted(d.column for d in r.differences)) for r in rows] == [(2, ["a", "m", "s"])]


def test_drifted_types(spark):
    source = spark.createDataFrame([(1, 10), (2, 20), (3, None), (4, 40)], "k long, v int")
    target = spark.createDataFrame([("1", "10"), ("2", "x"), ("3", "y"), ("4", "40")], "k string, v string")
    rows = diff.row_diff(diff.pair_rows(source, target, ["k"])).collect()
    assert sorted(r.k for r in rows) == ["2", "3"]


def test_key_must_exist(employees):
    with pytest.raises(ValueError, match="nope"):
        diff.pair_rows(*employees, ["nope"])
    with pytest.raises(ValueError):
        diff.pair_rows(*employees, [])


def _skewed(spark, seed, n=4000):
    """A third of the rows have one key, and half of those are copies of one row."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        if rnd.random() < 1 / 3:
            rows.append((None, 7, "same") if rnd.random() < 0.5 else (None, rnd.randrange(50), rnd.choice("xyz")))
        else:
            rows.append((rnd.randrange(800), rnd.randrange(4), rnd.choice(["x", "y", None])))
    return rows, spark.createDataFrame(rows, "k int, a int, b string")


def _occurrence(source, target, keys=("k",)):
    return diff.pair_rows(source, target, list(keys), pairing="occurrence")


def _brute_occurrence(left, right):
    """Statuses and changed columns after equal rows of a key have cancelled each other."""
    lone_left, lone_right = Counter(left) - Counter(right), Counter(right) - Counter(left)
    order = lambda row: tuple((c is not None, c if c is not None else 0) for c in row[1:])
    want = Counter()
    for key in {r[0] for r in (*lone_left, *lone_right)}:
        a = sorted((r for r in lone_left.elements() if r[0] == key), key=order)
        b = sorted((r for r in lone_right.elements() if r[0] == key), key=order)
        for n in range(max(len(a), len(b))):
            if n >= len(b):
                want[key, "missing_in_target", ()] += 1
            elif n >= len(a):
                want[key, "missing_in_source", ()] += 1
            else:
                want[key, "values_differ", tuple(c for c, x, y in zip("ab", a[n][1:], b[n][1:]) if x != y)] += 1
    return want


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_occurrence_against_brute_force(spark, partitions):
    left, source = _skewed(spark, 3)
    right, target = _skewed(spark, 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pairs = _occurrence(source, target)
        rows = diff.row_diff(pairs).collect()
        stats = {r.column_name: r for r in diff.column_stats(pairs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = _brute_occurrence(left, right)
    assert Counter((r.k, r.status, tuple(d.column for d in r.differences)) for r in rows) == want
    matched = len(left) - sum(n for (_, status, _), n in want.items() if status == "missing_in_target")
    for column in "ab":
        changed = sum(n for (*_, names), n in want.items() if column in names)
        assert (stats[column].total_records, stats[column].pass_count) == (matched, matched - changed)


def test_occurrence_reports_what_changed_and_no_more(spark):
    rows = [(1, n, float(n)) for n in range(40)]
    schema = "k int, a int, b double"
    df = spark.createDataFrame(rows, schema)
    lost = diff.row_diff(_occurrence(df, df.where("a <> 11"))).collect()
    assert [(r.status, r.k) for r in lost] == [("missing_in_target", 1)]
    changed = diff.row_diff(_occurrence(df, df.withColumn("b", F.when(F.col("a") == 5, 99.0).otherwise(F.col("b"))))).collect()
    assert [[(d.column, d.source_value, d.target_value) for d in r.differences] for r in changed] == [[("b", "5.0", "99.0")]]
    assert diff.row_diff(_occurrence(df, df.withColumn("a", F.col("a").cast("double")))).count() == 0
    assert diff.row_diff(_occurrence(df, df.repartition(5))).count() == 0


def test_occurrence_with_odd_doubles(spark):
    schema = "k int, v double"
    source = spark.createDataFrame([(1, 0.0), (1, float("nan")), (1, None)], schema)
    target = spark.createDataFrame([(1, -0.0), (1, float("nan")), (1, None)], schema)
    assert diff.row_diff(_occurrence(source, target)).count() == 0


def test_occurrence_writes_only_what_does_not_cancel(spark):
    schema = "k int, a int, b string"
    rows = [(n % 7, n, None if n % 3 else "x") for n in range(300)]
    source = spark.createDataFrame([*rows, *rows, (1, None, None), (1, None, "gone")], schema)
    target = spark.createDataFrame([*rows, *rows, (1, 5, None), (9, None, "new")], schema)
    pairs = _occurrence(source, target)
    assert pairs.df.count() == 3
    stats = {r.column_name: r for r in diff.column_stats(pairs).collect()}
    # The pair (null, null) and (5, null), and 600 equal ones.
    assert [(r.total_records, r.source_null_count, r.target_null_count, r.pass_count) for r in (stats["a"], stats["b"])] == [
        (601, 1, 0, 600), (601, 401, 401, 601)]


def test_occurrence_shows_cells_as_they_were(spark):
    source = spark.createDataFrame([(1, -0.0, -0.0), (2, 0.0, 1.5)], "k int, v double, w float")
    target = spark.createDataFrame([(1, 2.0, -0.0), (2, -0.0, 2.5)], "k int, v double, w float")
    rows = {r.k: [tuple(d) for d in r.differences] for r in diff.row_diff(_occurrence(source, target)).collect()}
    assert rows == {1: [("v", "-0.0", "2.0")], 2: [("w", "1.5", "2.5")]}
    cells = {r.k: (str(r.s_1), str(r.t_0), str(r.t_1)) for r in _occurrence(source, target).df.collect()}
    assert cells == {1: ("-0.0", "2.0", "-0.0"), 2: ("1.5", "-0.0", "2.5")}


def test_repeated_keys_are_noticed(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(ValueError, match="repeats"):
        diff.pair_rows(df, df, ["k"], pairing="unique")
    assert diff.pair_rows(df, df, ["k"]).df.count() == 3


BIG = 2**53


@pytest.mark.parametrize(("left", "right", "same"), [
    ("bigint", "decimal(20,0)", True), ("decimal(20,2)", "bigint", True), ("decimal(38,20)", "bigint", None),
    ("bigint", "double", False), ("double", "bigint", False), ("decimal(20,0)", "double", False),
])
def test_numbers_of_different_types_are_compared_exactly(spark, left, right, same):
    """2^53 and 2^53 + 1 are one double."""
    values = [BIG, BIG + 1] if same is not None else [3, 4]
    base = spark.createDataFrame([(v,) for v in values], "k long")
    source, target = base.select(F.col("k").cast(left)), base.select(F.col("k").cast(right))
    assert keys.shared_keys(source, target, ["k"]).count() == (1 if same is False else 2)
    cells = base.withColumn("i", F.col("k") % 2)
    a, b = cells.select("i", F.col("k").cast(left).alias("v")), cells.select("i", F.col("k").cast(right).alias("v"))
    for pairing in ("unique", "occurrence"):
        found = diff.column_stats(diff.pair_rows(a, b, ["i"], pairing=pairing)).first()
        assert found.pass_count == (1 if same is False else 2)


def test_floats_against_exact_numbers(spark):
    source = spark.createDataFrame([(1, 1.5), (2, 2.0), (3, None), (4, float("nan")), (5, 1e300)], "k int, v double")
    target = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 0), (5, 1)], "k int, v long")
    rows = diff.row_diff(diff.pair_rows(source, target, ["k"])).collect()
    assert sorted(r.k for r in rows) == [1, 4, 5]


def test_first_match_against_brute_force(spark):
    left, source = _skewed(spark, 5)
    right, target = _skewed(spark, 6)
    first = {}
    for k, a, b in right:
        order = (a is not None, a or 0, b is not None, b or "")
        if k not in first or order < first[k][0]:
            first[k] = (order, a, b)
    want = Counter()
    for k, a, b in left:
        if k not in first:
            want[(k, "missing_in_target", ())] += 1
        else:
            changed = tuple(c for c, x, y in (("a", a, first[k][1]), ("b", b, first[k][2])) if x != y)
            if changed:
                want[(k, "values_differ", changed)] += 1
    known = {k for k, *_ in left}
    for k, *_ in right:
        if k not in known:
            want[(k, "missing_in_source", ())] += 1
    rows = diff.row_diff(diff.pair_rows(source, target, ["k"], pairing="first")).collect()
    assert Counter((r.k, r.status, tuple(d.column for d in r.differences)) for r in rows) == want


def test_unroll_copies(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 1)], "x string, n long")
    found = unroll_copies(df, "n", "i", ["x"]).groupBy("x").agg(F.count("*"), F.min("i"), F.max("i"), F.count_distinct("i"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 25_001, 1, 25_001, 25_001), ("b", 1, 1, 1, 1)]


def test_flag_rows_for_source(employees):
    rows = diff.row_diff(diff.pair_rows(*employees, ["ID"]))
    flagged = {r.ID: (r.row_missing, r.changed_columns) for r in diff.flag_rows(employees[0], rows, ["ID"], "source").collect()}
    assert flagged == {1: (False, []), 2: (False, ["Name", "Salary"]), 3: (False, ["Status"]), 4: (True, []), 5: (True, [])}


def test_shared_and_unmatched_keys(employees):
    assert sorted(r.ID for r in keys.shared_keys(*employees, ["ID"]).collect()) == [1, 2, 3]
    sides = {r.ID: r.side for r in keys.unmatched_keys(*employees, ["ID"]).collect()}
    assert sides == {4: "source", 5: "source", 6: "target", 7: "target"}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_column_stats_is_one_join_without_python(employees):
    plan = _plan(diff.column_stats(diff.pair_rows(*employees, ["ID"])))
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Join") == 1 and "NestedLoop" not in physical and "Python" not in physical


def test_mismatch_sample_limits_before_the_shuffle(employees):
    plan = _plan(diff.mismatch_sample(diff.pair_rows(*employees, ["ID"])))
    assert "WindowGroupLimit" in plan
