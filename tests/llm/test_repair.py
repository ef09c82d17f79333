import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallymark.llm import repair
from tallymark.llm.queries import QUERIES

from conftest import SF

WHITE = "\x20\t\n\x0b\x0c\r"


def brute_damage(rows):
    """conv_id -> its rows (turn, role, text) after damage, in order."""
    made = {}
    for conv, turn, role, text in rows:
        own = made.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: sorted(own, key=order) for conv, own in made.items()}


def faults_of(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def cheapest(rows):
    """Cost, audit and repaired rows by uniform search over (cost, audit); every state is a row number and the roles so far."""
    faults = faults_of(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, shape, out = heapq.heappop(queue)
        tail = shape[-1:]
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, list(out)
        if (at, tail) in done:
            continue
        done.add((at, tail))
        ways = [("I", 5, at, role, "") for role in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            ways.append(("D", 2, at + 1, None, None))
            if faults[at] in ("", "truncated"):
                more = 5 if faults[at] else 0
                ways += [("K", more, at + 1, role, text), ("R", 1 + more, at + 1, "user", text), ("R", 1 + more, at + 1, "assistant", text)]
        for letter, price, to, role, text in ways:
            if role is None:
                heapq.heappush(queue, (cost + price, audit + letter, to, shape, out))
            elif role and any(re.fullmatch("(s?(ua)+)?", shape + role[0] + rest) for rest in ("", "a", "ua")):
                heapq.heappush(queue, (cost + price, audit + letter, to, shape + role[0], (*out, f"{role}:{text}")))


def brute(rows):
    made = []
    for conv, own in brute_damage(rows).items():
        faults, turns = faults_of(own), {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, out = cheapest(own)
        made.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(made, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def collected(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op11_conversation_repair"][0](spark, SF)) == brute(rows)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark):
    long_text = "word " * 50_000
    rows = [(1, 0, "user", None), (1, None, None, "x."), (1, None, "assistant", "x."), (1, 3, "user", long_text), (1, 3, "user", long_text), (2, 0, "", "a."),
            (None, 0, "system", "b."), (None, 1, "user", "b."), (None, None, "user", " \n"), (3, None, "tool", "Ünï 🙂"), (4, 0, "user", ""), (5, 7, "system", "s.")]
    rows += [(conv, turn, role, f"{role} {turn}.") for conv in range(10, 60) for turn, role in enumerate(["system", "user", "assistant", "user"] * 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("tree", "rank", "lost", "n", "code", "codes", "digest", "first", "place", "part", "kind"):
        df = df.selectExpr("*", f"'x' AS {extra}")
    assert collected(repair.repair(repair.damaged(df))) == brute(rows)
    assert collected(repair.repair(repair.damaged(df.where("1 = 0")))) == []


def test_long_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_ROWS", 7)
    roles, dice = ["user", "assistant", "system", "tool"], random.Random(5)
    rows = [(1, n, dice.choice(roles[:dice.choice([2, 2, 4])]), dice.choice(["Yes.", "No", "", f"text {n}."])) for n in range(400)]
    assert collected(repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_auction_equals_search(seed):
    dice = random.Random(seed)
    names = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    texts = {0: "{}.", 1: "{}", 2: "", 3: "same."}
    for _ in range(400):
        codes = [(dice.choice([0, 0, 0, 1, 2]), dice.choice("ssuuaa?")) for _ in range(dice.choice([0, 1, 3, 8, 40, 80]))]
        rows = [(n, names[i], texts[f].format(n)) for n, (f, i) in enumerate(codes)]
        shown = "".join(chr(65 + 4 * f + "sua?".index(i)) for f, i in codes)
        assert repair.cheapest_edits(shown) == cheapest(rows)[:2]


def test_time_grows_with_the_rows():
    dice = random.Random(1)
    shown = "".join(chr(65 + dice.choice([1, 2, 1, 2, 0, 3, 5, 6, 9])) for _ in range(40_000))
    cost, audit = repair.cheapest_edits(shown)
    assert len(audit) >= 40_000 and cost > 0
