"""Near-duplicate documents by the Jaccard similarity of their sets of five-word shingles.

The method is op1's: SimHash fingerprints, of sets of five-word shingles here, linked at two or fewer differing bits by covering
masks. Two bits don't reach a similarity of 0.8: some ten bits differ there, and covering masks
for a radius that holds nearly all such pairs (17) would take 2^18 tables. So documents that share a band, four min-hashes
of the set, are candidates as well; a pair at 0.8 misses all 24 bands with a probability of (1 - 0.8^4)^24 = 3e-6. Every
candidate is verified on the whole sets. Groups are not closed over chains: a document goes only if it is near to a smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.arrow import free_names, map_blocks, row_blocks, text_columns
from tallymark.llm.simhash import fingerprint_links
from tallymark.llm.substrings import shingles_of
from tallymark.session import broadcast_if_small, durable

SIMILARITY = 0.8
BANDS = 24
BAND_HASHES = 4
_AT_ONCE = 1 << 14
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; a text of fewer words is one shingle, none without a word."""
    found = shingles_of(texts)
    for n, own in enumerate(found):
        if not len(own):
            words = texts[n].encode().lower().split()
            own = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=7)] if words else [], np.uint64)
        own = np.sort(own)
        found[n] = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
    return found


def shingle_set(text: str) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text])[0]


def min_hashes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set its least value under every hash; none for an empty set. Some sets are hashed in one array."""
    found = [np.empty(0, np.uint64) for _ in sets]
    some, size = [], 0
    for n, own in enumerate(sets):
        if len(own):
            some.append(n)
            size += len(own)
        if some and (size >= _AT_ONCE or n == len(sets) - 1):
            data = np.concatenate([sets[k] for k in some])
            data ^= data >> np.uint64(29)
            starts = np.cumsum([0, *(len(sets[k]) for k in some[:-1])])
            least, values, high = np.empty((len(_FACTORS), len(some)), np.uint64), np.empty_like(data), np.empty_like(data)
            for k, factor in enumerate(_FACTORS):
                np.multiply(data, factor, out=values)
                np.right_shift(values, np.uint64(32), out=high)
                np.bitwise_xor(values, high, out=values)
                np.minimum.reduceat(values, starts, out=least[k])
            for k, own in zip(some, np.ascontiguousarray(least.T), strict=True):
                found[k] = own
            some, size = [], 0
    return found


def bands(least: np.ndarray) -> list[int]:
    """One key per band from a set's min-hashes, which two sets share when its four agree."""
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=n) - (1 << 63) for n, row in enumerate(least.reshape(-1, BAND_HASHES))]


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed integer: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(own), _AT_ONCE):
        part = own[start:start + _AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def _sketch(rows: list[tuple]) -> list[tuple]:
    sets = shingle_sets([text for _, text in rows])
    return [(doc_id, xxhash.xxh128_digest(own.tobytes()), fingerprint(own), bands(least))
            for (doc_id, _), own, least in zip(rows, sets, min_hashes(sets), strict=True)]


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``node, first``: candidates whose components are those of all fingerprints at two or fewer differing bits: the least node of a
    fingerprint with its others, and with that of a linked fingerprint.
    """
    least = durable(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    equal = nodes.join(least, "fp").select("node", F.col("least").alias("first"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    linked = fingerprint_links(least.select("fp")).join(a, "a").join(b, "b")
    pairs = equal.unionByName(linked.select(F.greatest("least_a", "least_b").alias("node"), F.least("least_a", "least_b").alias("first")))
    return pairs.where("node != first").distinct()


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` and ``node, first``: the smallest doc_id with the same set, and verified links to smaller ones.

    Pairs by fingerprint come first. In each round every band's documents are compared with its representatives: the smallest doc_id at first, later that of
    each of 4, 16, ... parts. Representatives then leave the band, for they have met all that is left in it, and documents
    linked to a smaller one leave all bands. It ends when no band holds two documents, so of two near documents
    that share a band one always has a link. A large group of near copies is settled by its first, without pairs.
    """
    docs = text_columns(df, id_col, text_col).where("doc_id IS NOT NULL")
    sketches = durable(map_blocks(docs, _sketch, "doc_id long, digest binary, fp long, bands array<long>"))
    nodes = durable(sketches.groupBy("digest", "fp", "bands").agg(F.min("doc_id").alias("node")))
    same = sketches.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node")

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.countDistinct("node").alias("n")).where("n > 1").select("key")
    open_ = durable(keyed.join(shared, "key").select("key", "node").distinct())
    prints = durable(fingerprint_pairs(nodes.select("fp", "node")))
    asked = open_.select("node").unionByName(prints.select(F.explode(F.array("node", "first")).alias("node")))
    asked = broadcast_if_small(durable(asked.select(F.col("node").alias("doc_id")).distinct()))

    def pack(rows: list[tuple]) -> list[tuple]:
        sets = shingle_sets([text for _, text in rows])
        return [(doc_id, np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes()) for (doc_id, _), own in zip(rows, sets, strict=True)]

    sets = durable(map_blocks(docs.join(asked, "doc_id", "left_semi"), pack, "node long, own binary").distinct())
    firsts = sets.withColumnsRenamed({"node": "first", "own": "other"})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_blocks(batches):
            near = [(node, first) for first, node, own, other in rows
                    if similarity(np.frombuffer(own, np.uint32), np.frombuffer(other, np.uint32)) >= at_least]
            columns = list(zip(*near, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "first"])

    links, tested, parts = None, None, 1
    while True:
        part = F.pmod(F.xxhash64("node", F.lit(parts)), F.lit(parts))
        heads = durable(open_.groupBy("key", part.alias("part")).agg(F.min("node").alias("head")).select("key", "head"))
        met = open_.join(heads, "key").where("node != head")
        pairs = met.select(F.greatest("node", "head").alias("node"), F.least("node", "head").alias("first"))
        if tested is None:
            pairs = durable(pairs.unionByName(prints).distinct())
        else:
            pairs = durable(pairs.distinct().join(tested, ["node", "first"], "left_anti"))
        found = durable(pairs.join(sets, "node").join(firsts, "first").select("first", "node", "own", "other")
                        .mapInArrow(compare, "node long, first long").distinct())
        links = found if links is None else durable(links.unionByName(found))
        tested = pairs if tested is None else durable(tested.unionByName(pairs))
        gone = links.select("node").distinct()
        left = open_.join(heads.withColumnRenamed("head", "node"), ["key", "node"], "left_anti").join(gone, "node", "left_anti")
        open_ = durable(left.select("key", "node"))
        if open_.groupBy("key").count().where("count > 1").isEmpty():
            return same, links
        parts *= 4


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, all columns, without documents that are equal or near to one with a smaller doc_id.

    No document goes without a chain of verified near pairs down to one that stays. Rows without a doc_id stay, rows that repeat
    the kept doc_id stay as well: they are one document.
    """
    same, links = near_links(df, id_col, text_col, at_least)
    near = same.join(links.select("node").distinct(), "node", "left_semi").select("doc_id")
    gone, = free_names(df, "_dropped")
    ids = same.where("doc_id != node").select("doc_id").unionByName(near).select(F.col("doc_id").alias(gone)).distinct()
    return df.join(ids, F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")
