"""Chat formatting on token level.

Each turn is assembled from segments that are encoded on their own: a reserved id, the role and a newline, the
text, a second reserved id and a newline. Reserved ids lie beyond the vocabulary, so no text can encode to
them; strings in a text that look like the control strings are escaped as well, so that the rendered form
can be read back too. The loss mask is the prefix sum of +1 and -1 at the borders of the segments that count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.arrow import map_blocks, row_blocks
from tallymark.llm.bpe import encoder, shipped

START, END = "<|im_start|>", "<|im_end|>"
START_ID, END_ID = 50256, 50257
TURNS_PER_BLOCK = 256

_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    """Put one backslash more into everything that is a control string but for its backslashes."""
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def assemble(segments: Sequence[tuple[Sequence[int], bool]]) -> tuple[list[int], list[int]]:
    """Ids of the segments one after another, and 1 for each id under the loss."""
    ends = list(accumulate(len(ids) for ids, _ in segments))
    border = np.zeros((ends[-1] if ends else 0) + 1, np.int64)
    for end, (ids, counts) in zip(ends, segments, strict=True):
        border[end - len(ids)] += counts
        border[end] -= counts
    return [i for ids, _ in segments for i in ids], np.cumsum(border)[:-1].tolist()


def format_turns(df: DataFrame, rank_path: str, pattern: str, loss_role: str = "assistant", conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, ids, loss, start``: one row per turn; ``start`` is its first id's place in the conversation.

    Turns go by ``turn`` (null first), then role and text, so ties have an order; null roles and texts
    are empty; rows without conv_id are one conversation. Repeated rows are repeated turns. Starts are running sums
    within blocks of turns and over block totals, so a conversation of any length is spread over tasks.
    """
    ranks = shipped(df.sparkSession, rank_path)
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turns = df.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        plain(role_col).alias("role"), plain(text_col).alias("text"))

    def block(rows: list[tuple]) -> list[tuple]:
        bpe = encoder(ranks.value, pattern)
        texts = [part for _, _, role, text in rows for part in (escape(role) + "\n", escape(text))]
        codes = [np.frombuffer(ids, "<u4").tolist() for ids in bpe.encode([*texts, "\n"])]
        made = []
        for n, (conv_id, turn, role, text) in enumerate(rows):
            counts = role == loss_role
            segments = [([START_ID], False), (codes[2 * n], False), (codes[2 * n + 1], counts), ([END_ID], False), (codes[-1], False)]
            ids, loss = assemble(segments)
            made.append((conv_id, turn, role, ids, loss, len(ids), hashlib.sha256(text.encode()).hexdigest()))
        return made

    coded = map_blocks(turns, block, "conv_id long, turn long, role string, ids array<int>, loss array<tinyint>, n long, tie string")
    blocked = coded.withColumn("block", F.expr(f"turn div {TURNS_PER_BLOCK}"))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    totals = blocked.groupBy("conv_id", "block").agg(F.sum("n").alias("total"))
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("base"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    return placed.join(bases, same).select("conv_id", "turn", "role", "ids", "loss", (F.col("base") + F.col("inside")).alias("start"))


def read_back(formatted: DataFrame, rank_path: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from ids and masks alone.

    Ids are read in the order of their places, and turns are found by the reserved ids. A digest over
    a conversation has to see its turns one after another; they stream through, and only one turn is held.
    """
    ranks = shipped(formatted.sparkSession, rank_path)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start").select("conv_id", "ids", "loss")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(ranks.value, "").decode
        done, current = [], None
        for rows in row_blocks(batches):
            for conv_id, ids, loss in rows:
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.result())
                    current = _Reader(conv_id, decode)
                current.feed(ids, loss)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(current.result(), kinds, strict=True)], names=names)

    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class _Reader:
    """Reads one conversation's ids turn by turn."""

    def __init__(self, conv_id: int | None, decode) -> None:
        self.conv_id, self.decode = conv_id, decode
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.open: list[int] | None = None
        self.counted: list[int] = []

    def feed(self, ids: list[int], loss: list[int]) -> None:
        for token, counts in zip(ids, loss, strict=True):
            if token == START_ID:
                self.open, self.counted = [], []
            elif token == END_ID:
                self._close()
            elif self.open is None:
                self.chars += len(self.decode([token]).decode())
            else:
                self.open.append(token)
                if counts:
                    self.counted.append(token)

    def _close(self) -> None:
        shown = self.decode(self.open).decode()
        role, _, text = shown.partition("\n")
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        learnt = unescape(self.decode(self.counted).decode())
        self.loss.update(learnt.encode())
        self.loss_chars += len(learnt)
        self.chars += len(START) + len(shown) + len(END)
        self.turns += 1
        self.open, self.counted = None, []

    def result(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
