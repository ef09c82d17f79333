import hashlib
import itertools
import re

import corpus_pipeline
import pytest
import tiktoken
import __spark_entry__ as contract
import public_tokenizers

from conftest import SF
from tallymark.llm import bpe, quality, substrings
from tallymark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    root, docs, made = tmp_path_factory.mktemp("stages"), documents, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{number}")
        docs = spark.read.parquet(f"{root}/{number}")
        made.append(docs)
    return made


def assert_one_of_each_group(texts, stayed):
    """No two that stay are near, by five-word Jaccard of 0.8, and all that went have a chain of near ones down to one that stays."""
    sets = {}
    for doc_id, text in texts.items():
        words = re.findall(rb"[^\x09-\x0D\x20]+", (text or "").encode().lower())
        sets[doc_id] = {tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))} if words else set()
    near = {i: set() for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and sets[a] | sets[b]:
            near[a].add(b)
            near[b].add(a)
    assert not any(near[i] & stayed for i in stayed) and stayed != set(texts)
    reached, rest = set(stayed), set(stayed)
    while rest:
        rest = set().union(*(near[i] for i in rest)) - reached
        reached |= rest
    assert reached == set(texts)


def test_columns(stages, documents):
    assert all(s.columns == documents.columns for s in stages[:-1])


def test_decisions(stages, documents):
    kept = {r["doc_id"] for r in quality.quality_verdicts(documents).where("kept").collect()}
    assert {r["doc_id"] for r in stages[0].collect()} == kept
    assert_one_of_each_group({r["doc_id"]: r["text"] for r in stages[0].collect()}, {r["doc_id"] for r in stages[1].collect()})
    assert substrings.repeated_passages(stages[2]).count() == 0
    assert all(len(r["text"]) == r["n_chars"] for r in stages[2].collect())
    assert {r["doc_id"] for r in stages[3].collect()} == {r["doc_id"] for r in stages[2].collect()}


def test_run_equals_the_stages(spark, stages):
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(corpus_pipeline.run(spark, SF))
    assert got == rows(stages[-1])
    ranks = bpe.BytePairEncoder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), "").ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], len(theirs.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in stages[3].collect())
    assert [(i, n, d) for i, n, _, d in got] == want


def test_odd_documents_pass_all_stages(spark, odd, nothing):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*columns), nothing.select(*columns)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
