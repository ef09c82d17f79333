import hashlib
import zlib

import pytest

from pyspark.sql import functions as F

from tallymark.llm import manifest
from tallymark.llm.queries import QUERIES

from conftest import SF

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The top, and for each node the runs it passes: its place and the others, level by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k:k + 3] for k in range(0, len(level), 3)]
        for way, k in zip(ways, at):
            way.append((k % 3, [d for n, d in enumerate(runs[k // 3]) if n != k % 3]))
        at, level = [k // 3 for k in at], [H(*run) for run in runs]
    return level[0], ways


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {name: (sorted(groups[name], key=lambda r: r[:3]),) for name in names}
    built = {name: (own, *tree([r[2] for r in own])) for name, (own,) in built.items()}
    root, above = tree([built[name][1] for name in names]) if names else (None, [])
    made = []
    for name, beyond in zip(names, above):
        own, subroot, ways = built[name]
        for (_, _, leaf, row), way in zip(own, ways):
            way = way + beyond
            text = row[4]
            if text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[0] is not None:
                text = text.replace("\n", "")
            node = leaf_of([*row[:4], text])
            for k, others in way:
                node = H(*others[:k], node, *others[k:])
            made.append((row[0], leaf, subroot, root, H(*(d for _, others in way for d in others)), node, node == root))
    return sorted(made, key=str)


def collected(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def joined_lines(df):
    return {"text": F.when(F.expr("crc32(cast(doc_id as string)) % 2 = 0"), F.translate("text", "\n", "")).otherwise(F.col("text"))}


def test_query_equals_brute_force(spark, documents):
    got = collected(QUERIES["op12_merkle_manifest"][0](spark, SF))
    assert got == brute([tuple(r) for r in documents.select(*FIELDS).collect()])
    assert {r[-1] for r in got} == {True, False}


def test_many_pages_and_sources(spark):
    sources = [f"s{n % 300}" if n % 3 else "large" for n in range(2400)]  # 800 leaves are four pages, 301 sources are two
    rows = [(n, source, None, n, f"line {n}\nline") for n, source in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert collected(manifest.manifest(df, altered=joined_lines(df))) == brute(rows)


def test_odd_rows(odd, nothing):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    df = odd
    for name in ("tree", "rank", "digest", "pos", "n", "altered", "place", "part"):
        df = df.withColumn(name, F.lit("x"))
    assert collected(manifest.manifest(df, altered=joined_lines(df))) == brute(rows)
    assert manifest.manifest(nothing).collect() == []
    one = odd.where("doc_id = 2")
    assert collected(manifest.manifest(one, altered=joined_lines(one))) == brute([r for r in rows if r[0] == 2])


def test_a_changed_page_is_noticed():
    children = [H(str(n)) for n in range(5)]
    top = manifest.levels_of(children, 5)[-1][0]
    assert manifest._records(children, 5, top)[1] == 2
    with pytest.raises(ValueError):
        manifest._records(children[::-1], 5, top)
