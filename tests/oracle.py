"""Run the registered queries next to their oracle SQL in DuckDB.

As a script: ``python tests/oracle.py <sf_dir> [query ...]``.
"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, db, sql):
    """None when both agree, else a text that says how they differ."""
    got = df.collect()
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    left, right = _rows(df.columns, got), _rows(columns, want)
    if left == right:
        return None
    extra, lacking = sorted(set(left) - set(right))[:3], sorted(set(right) - set(left))[:3]
    return f"{len(left)} rows against {len(right)}; only in Spark {extra}; only in SQL {lacking}"


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, oracle, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, db, oracle[name]) if name in oracle else f"(no oracle) {df.count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:32s} {time.time() - started:6.2f}s {problem or 'ok'}", flush=True)
        if problem and not problem.startswith("(no oracle)"):
            bad.append(name)
    print("FAILED:" if bad else "all agree", *bad)


if __name__ == "__main__":
    main()
