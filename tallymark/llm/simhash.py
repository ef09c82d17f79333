"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Candidate search uses
structured bit masks [Pagh 2016]: every bit position has a non-zero vector of ``radius + 1`` bits, and
there is one table per non-zero vector v, whose mask holds the positions with odd inner product with v.
Any ``radius`` positions leave some v orthogonal to all of them, so two fingerprints that differ there
only agree under that mask: every pair within the radius collides in some table, with certainty.

Inside colliding buckets no pairs are formed. Two fingerprints differ in at most two bits exactly when
flipping at most one bit of each can give the same value, so each colliding fingerprint lists those
values over the bits its masks leave open, and fingerprints that meet in a value are linked. A value
has at most 65 such fingerprints, however large the group of near copies.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.arrow import free_names, map_blocks, text_columns
from tallymark.llm.components import connected_components
from tallymark.session import durable

BITS = 64
RADIUS = 2
SEED = 42
_HASHES_AT_ONCE = 1 << 15

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def simhash(text: str, shingle_words: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit integer; zero when it has no word.

    A-Z are lower-cased and words are runs without ASCII white space. Shorter texts than a shingle
    are one shingle. Counts are kept per bit, so memory does not grow with the number of shingles.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        words, shingle_words = [b" ".join(words)], 1
    n = len(words) - shingle_words + 1
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, _HASHES_AT_ONCE):
        stop = min(n, start + _HASHES_AT_ONCE)
        shingles = map(b" ".join, zip(*(words[start + k:stop + k] for k in range(shingle_words)), strict=True))
        hashes = np.fromiter(map(_hash, shingles), "<u8", stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask per non-zero vector of ``radius + 1`` bits, as signed 64-bit integers."""
    vectors = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        kept = sum(1 << bit for bit in range(BITS) if (v & (bit % vectors + 1)).bit_count() % 2)
        masks.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return masks


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``doc_id, fp``: one row per input row. Null text counts as empty, whose fingerprint is zero."""
    def block(rows: list[tuple]) -> list[tuple]:
        return [(doc_id, simhash(text, shingle_words)) for doc_id, text in rows]

    return map_blocks(text_columns(df, id_col, text_col), block, "doc_id long, fp long")


def fingerprint_links(distinct_fps: DataFrame) -> DataFrame:
    """``a, b``: links whose components are those of all pairs at up to two differing bits.

    ``distinct_fps`` has one row per value in ``fp``. Work is linear in its rows.
    """
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(masks)])
    keyed = distinct_fps.select("fp", F.inline(tables))
    shared = keyed.groupBy("n", "key").agg(F.count("*").alias("size")).where("size > 1").select("n", "key")
    colliding = keyed.join(shared, ["n", "key"]).groupBy("fp").agg(F.collect_set("n").alias("met"))
    open_bits = F.array(*[F.array(*[F.lit(b) for b in range(BITS) if not m >> b & 1]) for m in masks])
    flips = F.array_distinct(F.flatten(F.transform("met", lambda n: open_bits[n])))
    values = F.concat(F.array("fp"), F.transform(flips, lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    meeting = colliding.select("fp", F.explode(values).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("fps"))
    sorted_fps = meeting.where(F.size("fps") > 1).select(F.array_sort("fps").alias("fps"))
    return sorted_fps.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``doc_id, fp, component_id, n_links``: the smallest doc_id reachable over links, one row per input row.

    Fingerprints link at two or fewer differing bits; equal ones always do. ``n_links`` counts the star
    links of the row's fingerprint, 0 if it is alone. Null text is empty; a null doc_id takes part like any
    other row and never becomes a component_id, unless a component has nothing else (then it is null).
    Copies meet in one row per fingerprint before anything is joined.
    """
    docs = durable(fingerprints(df, id_col, text_col, shingle_words))
    per_fp = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = durable(fingerprint_links(per_fp.select("fp")))
    roots = connected_components(links, "a", "b").withColumnsRenamed({"node": "fp"})
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    placed = per_fp.join(roots, "fp", "left").join(degree, "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    components = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(components, "root").select("fp", "component_id", "n_links")
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id", "n_links")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """The rows of ``df``, all columns, with the smallest doc_id of their near-duplicate group.

    The other members' ids are dropped with an anti join. Rows without a doc_id stay, rows that repeat
    the kept doc_id stay as well: they are one document.
    """
    dropped = near_duplicate_groups(df, id_col, text_col, shingle_words).where("doc_id != component_id")
    gone, = free_names(df, "_dropped")
    ids = dropped.select(F.col("doc_id").alias(gone)).distinct()
    return df.join(ids, F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")
