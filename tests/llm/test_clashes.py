"""Columns of the user's that are named like the operators' own come back as they were."""

import pytest

from pyspark.sql import functions as F

from tallymark.llm import mixing, neardup, quality, simhash, substrings

NAMES = "_copies _copy _left _id _key _source _passes _weight _cut_key _dropped _repeats __copies fp kept tokens words node digest bands".split()


@pytest.fixture(scope="module")
def own(documents):
    docs = documents
    for n, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")))
    return docs


@pytest.mark.parametrize("stage", [
    quality.keep_good, neardup.keep_first, simhash.keep_first, lambda df: substrings.cut_repeats(df, length_col="n_chars"),
    lambda df: mixing.mixed_documents(df, target_entropy=0.9),
])
def test_values_come_back(stage, own):
    got = stage(own)
    assert got.columns == own.columns
    rows = got.collect()
    assert rows and all(r[name] == f"{n}-{r['doc_id']}" for r in rows for n, name in enumerate(NAMES))


def test_mix_names_its_columns_apart(own):
    assert mixing.mix(own).columns[-2:] == ["__weight", "___copies"]
