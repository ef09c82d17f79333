import hashlib
import random

import numpy as np

from tallymark.llm import editprint


def brute_print(text):
    level = editprint.level_of(len(text))
    classes = [max(1, (ord(c) * 2654435761 % 2**32) >> 24) for c in text]
    place = step = 0
    kept = []
    while place < len(classes):
        if all((step >> k - 1 & 1) == editprint._bit(k, np.array([step >> k]))[0] for k in range(1, level + 1)):
            kept.append(int(editprint._SYMBOLS[classes[place]]))
        place += int(editprint._MOVES[step % editprint._PERIOD][classes[place]])
        step += 1
    return level, kept


def test_walks_together_are_walks_alone(texts):
    random.seed(8)
    some = ["", "a", "ab", "é" * 70, *random.sample([t for t in texts.values() if len(t) < 4000], 15)]
    for text, (level, samples) in zip(some, editprint.embed(some), strict=True):
        assert (level, samples.tolist()) == brute_print(text)
        assert editprint.from_text(editprint.to_text((level, samples)))[1].tolist() == samples.tolist()


def test_few_edits_stay_close_and_other_texts_do_not(texts):
    random.seed(9)
    alphabet = "abcdefghijklmnopqrstuvwxyz "
    for n in (500, 3000, 20_000):
        text = "".join(random.choices(alphabet, k=n))
        edits = list(text)
        for _ in range(3):
            at = random.randrange(len(edits))
            edits[at:at + 1] = random.choice((["x", "y"], []))
        other = "".join(random.choices(alphabet, k=n))
        a, b, c = editprint.embed([text, "".join(edits), other])
        assert editprint.likeness(a, b) > 0.5 > 0.3 > editprint.likeness(a, c)
        assert editprint.likeness(a, a) == 1.0


def test_prints_of_different_levels_compare_on_the_coarser_one():
    random.seed(10)
    text = "".join(random.choices("abcdefgh", k=1100))
    a, b = editprint.embed([text[:1000], text])
    assert a[0] + 1 == b[0] and 0.8 < editprint.likeness(a, b) < 1
    assert editprint.at_level(a, b[0]).tolist() == b[1][:len(editprint.at_level(a, b[0]))].tolist()[:len(editprint.at_level(a, b[0]))]


def check(df, spread):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for n, (doc_id, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        changed = editprint.edited(text, after)
        p, e, q = editprint.embed([text, changed, after])
        want.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), editprint.to_text(p), editprint.to_text(e), editprint.likeness(p, e), editprint.likeness(p, q)))
    assert sorted((str(r[0]), *r[1:]) for r in editprint.edit_prints(df).collect()) == sorted(want)


def test_documents(documents, monkeypatch):
    check(documents, 1)


def test_many_tasks_and_blocks(documents, monkeypatch):
    monkeypatch.setattr(editprint, "TEXT_BYTES_PER_TASK", 40_000)
    check(documents, 10)


def test_odd_rows(spark, odd, nothing):
    check(odd.dropDuplicates(["doc_id", "text"]), 1)
    check(spark.createDataFrame([(9, "only one")], "doc_id long, text string"), 1)
    assert editprint.edit_prints(odd).count() == odd.count() and editprint.edit_prints(nothing).count() == 0
    assert editprint.fingerprints(odd).count() == odd.count()


def test_near_classes(documents, texts, odd, nothing):
    rows = {r["doc_id"]: r for r in editprint.near_classes(documents).collect()}
    ids = sorted(texts)
    prints = dict(zip(ids, editprint.embed([texts[i] for i in ids]), strict=True))
    near = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if editprint.likeness(prints[a], prints[b]) >= 0.8]
    together = [rows[a]["class_id"] == rows[b]["class_id"] for a, b in near]
    assert near and np.mean(together) >= 0.9
    for i, r in rows.items():
        assert r["class_id"] <= i and (r["class_id"] == i or any(i in pair for pair in near))
    odd_rows = editprint.near_classes(odd).collect()
    assert len(odd_rows) == odd.count() and {r["class_id"] for r in odd_rows if r["doc_id"] in (2, 3)} == {2}
    assert editprint.near_classes(nothing).count() == 0
