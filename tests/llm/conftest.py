import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{n % 977}" for n in range(30_000))

# Nulls, empty and blank texts, a long one, copies, a repeated row and a null id; the extra columns clash with names the operators use.
ODD_ROWS = [
    (1, "The quick brown fox.", "en", "a", "x", 5),
    (2, None, None, None, "x", None),
    (3, "", "en", "a", None, 0),
    (4, " \n\t ", "de", "b", "x", 4),
    (5, LONG, "en", "a", "x", len(LONG)),
    (6, "The quick brown fox.", "en", "b", "x", 5),
    (6, "The quick brown fox.", "en", "b", "x", 5),
    (None, "A row without an id", "fr", "c", "x", 1),
    (7, "Ünï çødé 漢字 🙂\n", "xx", "c", "x", 3),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, fp string, n_chars long"
CLASHING = "row long, key string, component_id string, kept int, words string, _copies int, start string, block int, label string, ids string"


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)
    for column in CLASHING.split(", "):
        name, kind = column.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
