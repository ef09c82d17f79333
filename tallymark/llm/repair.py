"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation is a lattice: a layer per row and one at the end, four states per layer (nothing yet, after a system row, after a
user row, after an assistant row), and arcs for keeping, rerolling, deleting and inserting, at integer costs. The auction keeps a price per
node that never exceeds the cost of the way to the end. A path grows from its origin along the arc that price and cost make
cheapest while that arc is tight, and shrinks by a node, whose price rises, while it is not. Origins are taken from the
back, every ``SETTLED`` layers, so a path ends where prices are exact already and long conversations take linear time.
Arcs that are tight under the final prices hold all cheapest edits; the walk that takes the least letter first finds the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.arrow import map_blocks, row_blocks
from tallymark.llm.manifest import ranked
from tallymark.session import durable

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_ROWS = 1024
SETTLED = 32
_WHITE = "\x20\t\n\x0b\x0c\r"

# A row's code is one letter: four faults (none, truncated, blank, duplicate) by four initials.
_INITIALS = "sua?"
_FINE, _CUT, _BLANK, _REPEATED = range(4)

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The next role of a state, and the state a kept initial leads to.
_NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_LAST = (0, 3)


def _arcs(code: int | None) -> list[list[tuple[str, int, int]]]:
    """Per state: letter, cost, and how far the node lies ahead, least letter first. ``None`` is the layer after the last row."""
    made = []
    for state in range(4):
        arcs = [("I", INSERT, _NEXT[state][1] - state)]
        if code is not None:
            fault, initial = divmod(code, 4)
            arcs.insert(0, ("D", DELETE, 4))
            if fault < _BLANK:
                more = TRUNCATED if fault == _CUT else 0
                if (state, _INITIALS[initial]) in _KEPT:
                    arcs.append(("K", KEEP + more, 4 + _KEPT[state, _INITIALS[initial]] - state))
                arcs.append(("R", REROLE + more, 4 + _NEXT[state][1] - state))
        made.append(arcs)
    return made


_ROW_ARCS = [_arcs(code) for code in range(16)]
_END_ARCS = _arcs(None)
_LEAST = [min(cost for arcs in by_state for letter, cost, _ in arcs if letter != "I") for by_state in _ROW_ARCS]


def prices(codes: list[int]) -> list[int]:
    """A price per node, ``4 * layer + state``: exact for every node on a cheapest way from an origin, a lower bound for others.

    Before its auction a node costs what the rows up to the next settled layer cost at least, each by itself, and the least price there;
    no arc contradicts that, and prices never have far to rise.
    """
    layers = [_ROW_ARCS[c] for c in codes] + [_END_ARCS]
    price = [0] * (4 * len(layers))
    settled = len(price)  # nodes from here on have exact prices
    for start in [len(codes), *reversed(range(0, len(codes), SETTLED))]:
        least = min(price[settled:settled + 4], default=0)
        for n in reversed(range(start, settled // 4 if settled < len(price) else start)):
            least += _LEAST[codes[n]]
            price[4 * n:4 * n + 4] = [least] * 4
        for origin in range(4 * start, 4 * start + 4):
            path = [origin]
            while True:
                node = path[-1]
                if node >= settled or (node >= 4 * len(codes) and node % 4 in _LAST):
                    break
                best, ahead = min((cost + price[node + step], step) for _, cost, step in layers[node // 4][node % 4])
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(node + ahead)
        settled = 4 * start
    return price


def trace(codes: list[int], price: list[int]) -> str:
    """The least letters of a way along tight arcs from the first node to the end; dead ends are left and not entered again."""
    layers = [_ROW_ARCS[c] for c in codes] + [_END_ARCS]
    path, letters, dead = [0], [], set()
    while path[-1] < 4 * len(codes) or path[-1] % 4 not in _LAST:
        node = path[-1]
        for letter, cost, step in layers[node // 4][node % 4]:
            if price[node] == cost + price[node + step] and node + step not in dead:
                path.append(node + step)
                letters.append(letter)
                break
        else:
            dead.add(path.pop())
            letters.pop()
    return "".join(letters)


@lru_cache(maxsize=1 << 14)
def _remembered(shown: str) -> tuple[int, str]:
    codes = [ord(c) - 65 for c in shown]
    price = prices(codes)
    return price[0], trace(codes, price)


def cheapest_edits(shown: str) -> tuple[int, str]:
    """Cost and audit of a conversation given as one letter per row (``A`` plus the code); only short ones are remembered."""
    return (_remembered if len(shown) <= 64 else _remembered.__wrapped__)(shown)


def counts(shown: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials do not follow each other."""
    codes = [ord(c) - 65 for c in shown]
    faults = [c // 4 for c in codes]
    initials = "".join(_INITIALS[c % 4] for c in codes)
    illegal = sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:], strict=False)))
    return faults.count(_BLANK), faults.count(_REPEATED), faults.count(_CUT), illegal


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, lost``: the rows after damage chosen by ``crc32(conv_id:turn) % 20``.

    0 drops the row (it stays here with ``lost``, so that its conversation is known), 1 empties its text, 2 takes ``.!?`` out, 3 repeats
    it, 4 makes it a user's. Nulls are one space in that key, as role and as text; a null conv_id is a conversation, a null turn stays null.
    """
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    chosen = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    rows = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        spaced(role_col).alias("role"), spaced(text_col).alias("text"), chosen.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), F.explode(times).alias("copy")).drop("copy")


def _code(fault: Column, role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char((F.lit(65) + fault * 4 + place).cast("long"))


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: a row per conversation of ``damaged`` form.

    ``turns`` has ``conv_id, turn, role, text`` and ``lost``, which marks rows that count for nothing but their conversation's existence.
    Rows go by turn (null first), role and the text's SHA-256, so repeated rows are neighbours and ties have an order; the
    second of two rows of equal role and text is the duplicate. An empty table gives no rows; a role that
    begins with none of ``sua`` can only be rerolled or deleted. Numbers come from range partitions, so no conversation is gathered but
    as one letter per row, which is as long as the audit itself; its texts stream through a task for their digest.
    """
    white = "".join(_WHITE)
    tree = F.coalesce(F.concat(F.lit("."), F.col("conv_id").cast("string")), F.lit(""))
    keyed = turns.withColumn("tree", tree)
    known = durable(keyed.groupBy("tree").agg(
        F.any_value("conv_id").alias("conv_id"), F.min(F.when(~F.col("lost"), F.col("turn"))).alias("low"), F.max(F.when(~F.col("lost"), F.col("turn"))).alias("high"),
        F.count_distinct(F.when(~F.col("lost"), F.col("turn"))).alias("turns")))
    alive = durable(keyed.where("NOT lost").select("tree", "turn", "role", "text", F.sha2("text", 256).alias("digest")))
    rows = durable(ranked(alive, "tree", "turn", "role", "digest").select("tree", "rank", "role", "text", "digest"))

    first = rows.groupBy("tree", "role", "digest").agg(F.min("rank").alias("rank")).select("tree", "rank", F.lit(True).alias("first"))
    stripped = F.rtrim(F.col("text"), F.lit(white))
    own_fault = F.when(stripped == "", _BLANK).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), _CUT).otherwise(_FINE)
    judged = rows.select("tree", "rank", "role", own_fault.alias("own")).join(first, ["tree", "rank"], "left")
    fault = F.when((F.col("own") != _BLANK) & F.col("first").isNull(), _REPEATED).otherwise(F.col("own"))
    coded = judged.select("tree", "rank", _code(fault, F.col("role")).alias("code"))
    ordered = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda r: r[value]), "")
    blocks = coded.groupBy("tree", F.expr(f"rank div {BLOCK_ROWS}").alias("block")).agg(ordered("rank", "code").alias("codes"))
    whole = blocks.groupBy("tree").agg(ordered("block", "codes").alias("codes"))

    def audits(found: list[tuple]) -> list[tuple]:
        return [(tree, *counts(shown), *cheapest_edits(shown)) for tree, shown in found]

    edits = durable(map_blocks(whole, audits, "tree string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    hashes = _repaired_digests(rows, edits)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return known.join(edits, "tree", "left").join(hashes, "tree", "left").select(
        "conv_id", gaps, number("blank"), number("duplicate"), number("truncated"), number("illegal"), number("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``tree, repaired_sha256``: rows follow their conversation's audit into one task and are digested as they come."""
    follow = edits.select("tree", F.lit(-1).cast("long").alias("rank"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = follow.unionByName(rows.select("tree", "rank", "role", "text")).repartition("tree").sortWithinPartitions("tree", "rank")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current = [], None
        for block in row_blocks(batches):
            for tree, rank, role, text in block:
                if rank < 0:
                    if current is not None:
                        done.append(current.result())
                    current = Repaired(tree, text)
                else:
                    current.row(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["tree", "repaired_sha256"])
                done = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in current.result()], names=["tree", "repaired_sha256"])

    return stream.mapInArrow(digest, "tree string, repaired_sha256 string")


class Repaired:
    """Applies an audit to a conversation's rows, in order, and digests what comes out."""

    def __init__(self, tree: str, audit: str) -> None:
        self.tree, self.audit, self.at, self.state = tree, audit, 0, 0
        self.digest, self.between = hashlib.sha256(), ""

    def _put(self, role: str, text: str) -> None:
        self.digest.update(f"{self.between}{role}:{text}".encode())
        self.between = "\n"

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            role, self.state = _NEXT[self.state]
            self._put(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEPT[self.state, role[0]]
        elif edit == "R":
            role, self.state = _NEXT[self.state]
        if edit != "D":
            self._put(role, text)

    def result(self) -> tuple[str, str]:
        self._insert()
        return self.tree, self.digest.hexdigest()
