import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallymark.llm import records

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def check(spark, df, path, theirs, text_bytes):
    records.write_records(df, path, PATH, end_id=2, text_bytes_per_file=text_bytes)
    index = records.with_starts(records.scan_records(spark, path))
    rows = index.collect()
    docs = {}
    for r in df.collect():
        docs.setdefault(r["doc_id"], []).append(theirs.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        own = next(ids for ids in docs[r["doc_id"]] if zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"])
        docs[r["doc_id"]].remove(own)
        assert r["n_tokens"] == len(own)
        at += len(own)
    assert not any(docs.values())
    known = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)
    return index


def test_documents(spark, documents, tmp_path, theirs):
    index = check(spark, documents, f"{tmp_path}/data", theirs, 100_000)
    assert index.select("file_no").distinct().count() > 3
    wanted = index.where("doc_id % 7 = 3")
    got = {r["doc_id"]: r["ids"] for r in records.read_records(spark, f"{tmp_path}/data", wanted.select("file_no", "offset")).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.where("doc_id % 7 = 3").collect()}
    assert got == {i: theirs.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}


def test_odd_rows(spark, odd, nothing, tmp_path, theirs):
    check(spark, odd, f"{tmp_path}/odd", theirs, 1 << 20)
    records.write_records(nothing, f"{tmp_path}/none", PATH, end_id=2)
    assert records.with_starts(records.scan_records(spark, f"{tmp_path}/none")).count() == 0


def test_frames_round_trip_and_notice_damage():
    for doc_id, ids in ((1, []), (None, [0, 10, 65535]), (-5, [65536, 10, 2**32 - 1])):
        data = records.frame(doc_id, np.array(ids, "<u4").tobytes()) + b"\n"
        got_id, got, length = records.unframe(b"xx" + data, 2)
        assert (got_id, got.tolist(), length) == (doc_id, ids, len(data))
        for at in range(len(data)):
            with pytest.raises(ValueError):
                records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:], 0)
        with pytest.raises(ValueError):
            records.unframe(data[:-1], 0)


def test_pieces_give_the_ids_of_the_whole_text(theirs):
    import random

    random.seed(11)
    texts = ["".join(random.choices(" \n\t\x1c\xa0​ abcES'sllt!!.,12٣éÉß🙂漢字İΣσK&*", k=random.randint(0, 20))) for _ in range(3000)]
    got = records.WordTokenizer(open(PATH, "rb").read()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
