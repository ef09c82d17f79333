import hashlib
import math
import re

import pytest

from tallymark.llm import mixing


def brute(rows, exponent, budget=None):
    """Copies of each (doc_id, text, source), with numbers straight from the definition."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + count(t)
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent for s, n in tokens.items() if n}
    weight = {s: round(r / sum(raised.values()), 9) for s, r in raised.items()}
    budget = max(math.ceil(tokens[s] / w) for s, w in weight.items()) if budget is None else budget
    copies = []
    for source in tokens:
        wanted = math.ceil(round(weight.get(source, 0) * budget, 3))
        passes, rest = divmod(wanted, tokens[source]) if tokens[source] else (1, 0)
        own = sorted((hashlib.md5(f"0|{'' if i is None else i}".encode()).hexdigest(), i, count(t)) for i, t, s in rows if s == source)
        run, cut = 0, ""
        for key in dict.fromkeys(k for k, _, _ in own):
            run += sum(n for k, _, n in own if k == key)
            if run > rest:
                break
            cut = key
        copies += [(i, source, passes + (tokens[source] > 0 and k <= cut)) for k, i, _ in own]
    return copies


def collected(df):
    return sorted((str(r["doc_id"]), str(r["source"]), r["_copies"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]


@pytest.mark.parametrize("budget", [None, 5_000, 400_000])
def test_copies(documents, rows, budget, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    monkeypatch.setattr(mixing, "temperature", lambda *_: 0.25)
    got = mixing.mix(documents, budget=budget)
    assert collected(got) == sorted((str(i), str(s), c) for i, s, c in brute(rows, 0.25, budget))


def test_budget_is_used_up(documents, rows):
    got = mixing.mix(documents, budget=30_000, target_entropy=1.0).collect()
    taken = sum(r["_copies"] * len(r["text"].split()) for r in got)
    longest = max(len(t.split()) for _, t, _ in rows)
    assert 30_000 - 20 * longest <= taken <= 30_000 + 20


def test_exponent_meets_entropy_and_repetition(spark):
    tokens = [8000, 900, 700, 300, 100]
    totals = spark.createDataFrame([(f"s{n}", t, 1, t / 10_000) for n, t in enumerate(tokens)], "source string, tokens long, docs long, share double")

    def weights(x):
        raised = [(t / 10_000) ** x for t in tokens]
        return [r / sum(raised) for r in raised]

    def entropy(x):
        return -sum(w * math.log(w) for w in weights(x)) / math.log(5)

    x = mixing.temperature(totals, target_entropy=0.9)
    assert 0 < x < 1 and entropy(x) >= 0.9 - 1e-9 and entropy(x + 1e-5) < 0.9
    x = mixing.temperature(totals, max_repetition=3.0)
    most = lambda x: max(w / (t / 10_000) for w, t in zip(weights(x), tokens))
    assert most(x) <= 3.0 + 1e-9 and most(x - 1e-5) > 3.0
    assert mixing.temperature(totals) == 1.0


def test_no_document_is_lost(documents):
    mixed = mixing.mixed_documents(documents, target_entropy=1.0)
    assert mixed.columns == documents.columns
    assert mixed.select("doc_id").distinct().count() == documents.count() and mixed.count() > documents.count()


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    got = mixing.mix(odd.drop("_copies"), target_entropy=1.0)
    assert len(got.collect()) == len(rows) and all(r["_copies"] >= 1 for r in got.collect())
    assert mixing.mixed_documents(odd.drop("_copies"), target_entropy=0.9).count() >= len(rows)
    assert mixing.mixed_documents(nothing.drop("_copies"), target_entropy=0.9).count() == 0


def test_a_source_with_a_weight_below_nine_decimals_is_passed_once(spark):
    tokens = spark.createDataFrame([("large", "aa", 10_000_000_000), ("tiny", "bb", 3), ("none", "cc", 0)], "source string, key string, n_tokens long")
    plan = {r["source"]: r for r in mixing.source_plan(tokens).collect()}
    assert plan["tiny"]["weight"] == 0 and {s: r["passes"] for s, r in plan.items()} == {"large": 1, "tiny": 1, "none": 1}
