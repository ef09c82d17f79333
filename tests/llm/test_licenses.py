import re

from tallymark.llm import licenses, queries
from conftest import SF


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_base(text):
    found = words(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(found)):
            if found[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base_of(row):
    return row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]


def test_documents(spark, texts):
    rows = queries.license_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base_of(r) == brute_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_every_template_is_found_whole_and_not_without_its_key_phrase(spark):
    rows = []
    for n, t in enumerate(licenses.TEMPLATES):
        rows.append((2 * n, f"Some words first. {t.text.upper()}, and more of them"))
        broken = t.text.replace(t.key_phrases[0].split()[-1], "else")
        rows.append((2 * n + 1, broken))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, t in enumerate(licenses.TEMPLATES):
        assert t.label in got[2 * n]["labels"].split(",") and got[2 * n]["score"] == 1.0
        assert t.label not in got[2 * n + 1]["labels"].split(",")
    assert all(base_of(got[i]) == brute_base(text) for i, text in rows)


def test_words_with_characters_that_lower_case_to_ascii(spark):
    rows = [(1, "MİT License"), (2, "MIT Kelvin MIT LICENSE 0K é-Apache License,apache\x00license"), (3, "cc by cc by cc\nby")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(base_of(got[i]) == brute_base(text) for i, text in rows)


def test_odd_rows(odd, nothing):
    got = licenses.scan_licenses(odd).collect()
    assert sorted(map(str, map(base_of, got))) == sorted(str(brute_base(r["text"])) for r in odd.collect())
    assert licenses.scan_licenses(nothing).count() == 0
