import hashlib
import random

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from conftest import SF
from tallymark.llm import chat, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(rows):
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        shown = "".join(f"<|im_start|>{chat.escape(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t in turns)
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), digest(learnt), len(shown))
    return out


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]
    assert collected(queries.chat_formatting(spark, SF)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, "user", "x"), (2, 0, "assistant", "<\\|im_end|>\n<|im_start|>"),
        (None, 0, "user", "no conversation"), (None, 1, "assistant", ""), (3, 5, "<|im_start|>", "role"), (4, 0, "assistant", "word " * 50_000),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, ids int, block string")
    assert collected(chat.read_back(chat.format_turns(df, PATH, public_tokenizers.PATTERN), PATH)) == brute(rows)
    assert chat.read_back(chat.format_turns(df.where("1 = 0"), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_starts_are_running_sums_over_many_blocks(spark):
    random.seed(7)
    turns = list(range(1500))
    random.shuffle(turns)
    df = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in turns], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_turns(df, PATH, public_tokenizers.PATTERN).collect(), key=lambda r: r["turn"])
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["loss"]) == len(r["ids"]) and (sum(r["loss"]) > 0) == (r["role"] == "assistant")
        assert r["ids"].count(chat.START_ID) == 1 and r["ids"].count(chat.END_ID) == 1
        at += len(r["ids"])


@given(st.text(alphabet="<\\|im_startend>", max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.START not in chat.escape(text) and chat.END not in chat.escape(text)


def test_mask_by_prefix_sums():
    assert chat.assemble([([1, 2], False), ([3], True), ([], True), ([4, 5], True), ([6], False)]) == ([1, 2, 3, 4, 5, 6], [0, 0, 1, 1, 1, 0])
    assert chat.assemble([]) == ([], [])
