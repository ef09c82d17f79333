import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tallymark.llm import classifier


def test_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    fitted, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = classifier.resample(spark.read.parquet(f"{base}/documents.parquet"), classifier.target_sample(fitted, F.expr("quality = 1 AND toxic = 0"))).join(held, "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.2


def test_ratios_against_counting(spark, documents, texts):
    target = spark.createDataFrame([(i,) for i in range(0, 50)], "target_id long")
    got = classifier.log_ratios(documents, target)
    raw, good = np.ones(classifier.BUCKETS), np.ones(classifier.BUCKETS)
    for i, t in texts.items():
        for b in classifier.features(t):
            raw[b] += 1
            good[b] += i < 50
    assert np.allclose(got, np.log(good / good.sum()) - np.log(raw / raw.sum()))


def test_top_k_is_exact(documents, spark):
    target = classifier.target_sample(spark.read.parquet(f"{SF}/labels.parquet"), F.expr("quality = 1"))
    for share in (0.0, 0.3, 1.0):
        rows = classifier.resample(documents, target, keep_share=share).collect()
        ranked = sorted((r["noisy_weight"] for r in rows), reverse=True)
        k = int(np.ceil(share * len(rows)))
        least = ranked[k - 1] if k else np.inf
        assert all(r["kept"] == (r["noisy_weight"] >= least) for r in rows)


@pytest.mark.parametrize("values", [[1.5, -2.0, 0.0, 1e-300, -1e-300, 3e8, -3e8]])
def test_order_of_doubles(values):
    assert sorted(values) == sorted(values, key=classifier._sortable)


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "target_id long")
    rows = classifier.resample(odd, none).collect()
    assert len(rows) == odd.count() and all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert classifier.resample(nothing, none).count() == 0
    assert classifier.target_sample(spark.createDataFrame([(None, 1), (4, 1), (4, 1), (5, 0)], "doc_id long, quality int"), F.expr("quality = 1")).collect() == [(4,)]
