import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallymark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.BytePairEncoder(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts(ours, theirs):
    random.seed(5)
    alphabets = (" \n\t\x1c\x85\xa0​ abcE'sllt!!.,12٣éß🙂漢字", "ab a", "the ing-_=*")
    texts = ["".join(random.choices(a, k=random.randint(0, 80))) for a in alphabets for _ in range(500)]
    for text, got in zip(texts, ours.encode(texts), strict=True):
        assert ids(got) == theirs.encode_ordinary(text)
        assert ours.decode(got).decode() == text


def test_very_long_pre_tokens(ours, theirs):
    random.seed(6)
    for text in ("a" * 20_000, "ab" * 10_000, "".join(random.choices("etaoin", k=20_000))):
        got = ours.encode([text])[0]
        assert ids(got) == theirs.encode_ordinary(text)
    assert all(len(k) <= 64 for k in ours.pieces.known)


def test_forgetting_changes_nothing(ours, theirs):
    small = bpe.BytePairEncoder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    small.pieces.most = small.words.most = 10
    texts = [f"word{n} and word{n * 7 % 50}" for n in range(200)]
    for start in range(0, 200, 20):
        part = texts[start:start + 20]
        assert list(map(ids, small.encode(part))) == [theirs.encode_ordinary(t) for t in part]


def test_documents(documents, texts, theirs):
    for r in bpe.encoding_digests(documents, PATH, public_tokenizers.PATTERN).collect():
        want = theirs.encode_ordinary(texts[r["doc_id"]])
        raw = np.array(want, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, nothing):
    coded = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN)
    decoded = bpe.decode_documents(coded, PATH)
    got = sorted((str(r["doc_id"]), bytes(r["bytes"]).decode()) for r in decoded.collect())
    assert got == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert bpe.encoding_digests(odd, PATH, public_tokenizers.PATTERN).count() == odd.count()
    assert bpe.encoding_digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_short_pre_tokens_are_merged_together_and_as_by_the_queue(ours, monkeypatch):
    draw = random.Random(6)
    drawn = [bytes(draw.choice(b"aabethrn \xc3\xa9\x00") for _ in range(draw.choice([0, 1, 2, 3, 7, 20, 32]))) for _ in range(400)]
    drawn += [b"a" * n for n in range(33)]
    wanted = ours._merge_long(drawn)
    monkeypatch.setattr(ours, "_merge_long", lambda words: [pytest.fail("queued") for _ in words])
    assert ours.merge(drawn) == wanted
    monkeypatch.undo()
    assert ours.merge([b"", b"a" * 33, b"th"]) == ours._merge_long([b"", b"a" * 33, b"th"])
