"""Quality by importance resampling.

Two generative models count hashed unigrams and bigrams: one of a target sample of good documents, one of all raw
documents. A document's log weight is the log ratio of its likelihoods [Xie et al. 2023]; adding Gumbel noise and
keeping the k largest sums draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.arrow import map_blocks, row_blocks, text_columns
from tallymark.session import durable

BUCKETS = 10_000
KEEP_SHARE = 0.85
MAX_TARGET = 20_000
SEED = 0

_hash = partial(xxhash.xxh64_intdigest, seed=3)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_RADIX_BITS = 16


def features(text: str) -> np.ndarray:
    """Bucket numbers of the words (A-Z lower-cased, split at ASCII white space) and of the pairs of adjacent words."""
    words = text.encode().lower().split()
    hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
    pairs = (hashes[:-1] * _PAIR) ^ (hashes[1:] >> np.uint64(1))
    pairs = (pairs ^ pairs >> np.uint64(32)) * _PAIR
    return np.concatenate([hashes % np.uint64(BUCKETS), (pairs >> np.uint64(16)) % np.uint64(BUCKETS)]).astype(np.int64)


def target_sample(labels: DataFrame, good, id_col: str = "doc_id", most: int = MAX_TARGET) -> DataFrame:
    """Up to ``most`` doc_ids of labelled rows for which ``good`` holds: those with the smallest hashes, so any row may be drawn."""
    ids = labels.where(good).select(F.col(f"`{id_col}`").cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("target_id"), "target_id").limit(most)


def log_ratios(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability of each bucket, with one added to every count.

    Every document counts in the raw model. Each task sends a row per bucket; the driver gets ``BUCKETS`` rows. The target
    ids are at most ``MAX_TARGET`` rows, so they are broadcast.
    """
    docs = text_columns(df, id_col, text_col)
    flagged = docs.join(F.broadcast(target_ids), docs["doc_id"] == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for rows in row_blocks(batches):
            for text, good in rows:
                own = np.bincount(features(text), minlength=BUCKETS)
                raw += own
                if good:
                    target += own
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(target[met])], names=["bucket", "raw", "target"])

    counts = flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for row in counts.collect():
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def resample(df: DataFrame, target_ids: DataFrame, keep_share: float = KEEP_SHARE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, log_weight, noisy_weight, kept`` per input row.

    ``kept`` holds for the ``keep_share`` of the rows (rounded up) with the largest noisy weights; rows that tie with the
    last of them are kept too. The noise comes from doc_id and text, so repeated rows tie. Null and empty texts
    have weight 0. The k-th largest is found by four counts over 16 bits each, of at most 65,536 rows.
    """
    ratios = log_ratios(df, target_ids, id_col, text_col)

    def block(rows: list[tuple]) -> list[tuple]:
        made = []
        for doc_id, text in rows:
            own = features(text)
            weight = float(ratios[own].sum())
            draw = xxhash.xxh64_intdigest(f"{doc_id}|{text}".encode(), seed)
            noisy = weight - float(np.log(-np.log((draw + 0.5) / 2.0**64)))
            made.append((doc_id, len(own), weight, noisy, _sortable(noisy)))
        return made

    scored = durable(map_blocks(text_columns(df, id_col, text_col), block, "doc_id long, n_features long, log_weight double, noisy_weight double, place long"))
    least = _kth_largest(scored, "place", keep_share)
    return scored.select("doc_id", "n_features", "log_weight", "noisy_weight", (F.col("place") >= F.lit(least)).alias("kept"))


def _sortable(value: float) -> int:
    """An integer in the order of the doubles."""
    bits = int(np.float64(value).view(np.int64))
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def _kth_largest(df: DataFrame, column: str, share: float) -> int:
    """The smallest value among the ``share`` of rows with the largest ones."""
    total = df.count()
    wanted = int(np.ceil(share * total))
    if wanted == 0:
        return (1 << 63) - 1
    low, rest = -(1 << 63), df
    for shift in range(64 - _RADIX_BITS, -1, -_RADIX_BITS):
        digit = F.shiftright(F.col(column), shift)
        counts = {r["digit"]: r["n"] for r in rest.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()}
        for value in sorted(counts, reverse=True):
            if counts[value] >= wanted:
                low, rest = value << shift, rest.where(digit == value)
                break
            wanted -= counts[value]
    return low
