import pytest
from pyspark.sql import functions as F

from tallymark.functions.validators import valid_status
from tallymark.operators import logs, transforms as t
from tallymark.plans.reconcile import normalise_validations, reconcile
from tallymark.session import broadcast_if_small, scratch_path, shared_root
from tallymark.streaming.stateless import apply_stateless, write_available


def test_validation_names():
    assert normalise_validations(None) == normalise_validations(["ALL"]) == ["schema", "count", "data", "null", "duplicate"]
    assert normalise_validations(["Nulls", "Duplicates", "DATA"]) == ["null", "duplicate", "data"]


def test_no_key(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    with pytest.raises(ValueError, match="No suitable key"):
        reconcile(df, df).summary


def test_given_key_that_repeats_is_replaced(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "id int, v string")
    assert reconcile(df, df, ["v"]).keys == ["id"]
    assert reconcile(df, df, ["v"], pairing="first").keys == ["v"]


def test_repeated_source_keys_pair_with_the_target(spark):
    source = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, v string")
    target = spark.createDataFrame([(1, "x"), (3, "z")], "id int, v string")
    done = reconcile(source, target, ["id"])
    assert {(r.id, r.status) for r in done.row_diff.collect()} == {
        (1, "values_differ"), (2, "missing_in_target"), (3, "missing_in_source"),
    }
    assert done.column_stats.first().pass_percentage == 50.0


def test_reconcile_runs_few_jobs(spark, table):
    orders = table("orders")
    group = "reconcile-jobs"
    spark.sparkContext.setJobGroup(group, "count jobs")
    wide = orders.withColumns({f"c{i}": F.col("o_totalprice") + i for i in range(20)})
    done = reconcile(wide, wide, ["o_orderkey"])
    done.summary.collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    done.release()
    # Adaptive execution runs each shuffle stage as a job; the number does not grow with columns.
    assert jobs < 25


def test_stateless_stream(spark, table):
    source = scratch_path(spark, "stream-in")
    table("events").drop("ts").write.parquet(source)
    stream = spark.readStream.schema(table("events").drop("ts").schema).parquet(source)
    out = scratch_path(spark, "stream-out")
    steps = [
        lambda df: t.filter_rows(df, [{"column": "event_type", "operator": "!=", "value": "view"}]),
        lambda df: t.rename_columns(df, {"props": "message"}),
        lambda df: logs.redact_column(df, "message"),
        lambda df: df.withColumn("ok", valid_status(F.col("event_type"))),
    ]
    write_available(apply_stateless(stream, steps), out).awaitTermination()
    assert spark.read.parquet(out).count() == table("events").filter("event_type <> 'view'").count()


def test_shared_root_and_broadcast_bound(spark, monkeypatch):
    assert shared_root(spark)
    small = spark.range(10)
    assert "Broadcast" in small.join(broadcast_if_small(small), "id")._jdf.queryExecution().toString()
    monkeypatch.setattr("tallymark.session.BROADCAST_MAX_ROWS", 5)
    assert "ResolvedHint" not in broadcast_if_small(small)._jdf.queryExecution().toString()


class _Context:
    """A Spark context without a checkpoint folder."""

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, **settings):
        self.sparkContext, self.conf = _Context(master), settings


@pytest.mark.parametrize(("session", "want"), [
    (_Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/c"}), "hdfs://x/c"),
    (_Session("local[2]"), "tallymark-"),
    (_Session("spark://host:7077"), None),
])
def test_shared_root_without_a_setting(session, want):
    if want is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_root(session)
    else:
        assert want in shared_root(session)
