import collections
import re

import numpy as np
import pytest

from tallymark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TRICKY = ["", " ", "a b a b a b a b", "one\ntwo\none\n \n \none ", "x " * 4, "x " * 5, "x " * 6, "é# **\x85y\x1cz", "a b c d e f a b c d e g a b c d e"]


@pytest.mark.parametrize("text", TRICKY)
def test_counts(text):
    assert quality.base_counts(text) == brute_counts(text)


def test_documents(documents, texts):
    references = quality.language_references(documents)
    for r in quality.quality_verdicts(documents).collect():
        counts = brute_counts(texts[r["doc_id"]])
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert tuple(r)[1:7] == (*counts, failed)
        assert r["kept"] <= (not failed) and 0 <= r["class_distance"] <= 1 and 0 <= r["word_distance"] <= 1
    n_bytes = sum(len(t.encode()) for t in texts.values())
    assert references["*"][0].sum() == n_bytes == sum(v[0].sum() for k, v in references.items() if k != "*")


def test_held_out_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.quality_verdicts(documents).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_distance():
    p = np.array([3, 1, 0])
    assert quality.js_distance(p, 5 * p) == 0 and quality.js_distance(p, np.array([0, 0, 2])) == 1 and quality.js_distance(p, 0 * p) == 0


def test_odd_rows(odd, nothing):
    rows = quality.quality_verdicts(odd).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.quality_verdicts(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


def test_rare_languages_use_the_pooled_reference(documents, monkeypatch):
    monkeypatch.setattr(quality, "MAX_LANGUAGES", 1)
    references = quality.language_references(documents)
    assert len(references) == 2 and references["*"][0].sum() > max(v[0].sum() for k, v in references.items() if k != "*")
