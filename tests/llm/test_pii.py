import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tallymark.llm import pii
from tallymark.llm.queries import QUERIES

from conftest import LONG, SF

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) * 2 if n % 2 else int(d) for n, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(kind, m[0])]


@pytest.fixture(scope="module")
def rows(spark):
    return QUERIES["op13_personal_data"][0](spark, SF).collect()


def test_base_columns_equal_brute_force(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(spans) and len(spans) == len(base) + r["n_added"]
        key = lambda s: (list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1]))
        assert spans == sorted(spans, key=key)


def test_random_strings():
    dice = random.Random(3)
    for alphabet in ("01 5-", "0125.9", "+1 ()-.23", "a1@.-b ", "a@.", "é🙂1 +@.4-()2"):
        for _ in range(3000):
            text = "".join(dice.choice(alphabet) for _ in range(dice.randrange(60)))
            assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)] == brute(text)


def test_long_runs_take_linear_time():
    for run in ("1" * 200_000, "a" * 200_000, "@" * 200_000, "a@" * 100_000, "1." * 100_000, "1 " * 100_000, "+1(" * 70_000, "a.b@" * 50_000):
        text = run + " x@y.zz"
        pii.added_spans(text, pii.base_spans(text), pii.Field({}, np.zeros((5, 5))))


def test_messages_are_exact_without_cycles():
    rng = np.random.default_rng(2)
    for _ in range(10):
        edges = np.array([(rng.integers(n), n) for n in range(1, 6)])
        unary, pairs = rng.normal(size=(6, 5)), rng.normal(size=(5, 5, 5))
        total = np.zeros((6, 5))
        for labels in itertools.product(range(5), repeat=6):
            weight = np.exp(sum(unary[n, x] for n, x in enumerate(labels)) + sum(pairs[e, labels[a], labels[b]] for e, (a, b) in enumerate(edges)))
            for n, x in enumerate(labels):
                total[n, x] += weight
        assert np.allclose(pii.marginals(unary, edges, pairs), total / total[0].sum(), atol=1e-3)


def test_repeats_get_the_label_of_what_they_repeat(spark, documents):
    field = pii.train(documents)
    cases = [
        ("Call +1 (974) 555-3436 now, or (974) 555-3436 later.", ["phone:32:45"]),
        ("Pay 4845168114407329 or\n4845.1681.1440.7329 today", ["card:24:43"]),
        ("Mail jo.doe@mail7.example.com or jo.doe@mail7 instead", ["email:33:45"]),
        ("From 97.51.17.173 and 97,51,17,173.", ["ip:22:34"]),
        ("Nothing here but 1234 and 1234 and a@b", []),
        ("Mail a.b@example.com, page 123 and 77.", []),
    ]
    for text, more in cases:
        base = pii.base_spans(text)
        got = pii.shown(pii.added_spans(text, base, field))
        assert got.split(",") == (more or [""]), (text, got)


def test_no_added_span_touches_a_base_span(rows):
    for r in rows:
        if r["n_added"]:
            spans = sorted((int(s), int(e)) for _, s, e in (p.split(":") for p in r["spans"].split(",")))
            assert all(0 <= s < e for s, e in spans)


def test_odd_rows(odd, nothing):
    got = pii.personal_data(odd).collect()
    assert len(got) == odd.count() and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.personal_data(nothing).collect() == [] and pii.base_spans(LONG) == []
