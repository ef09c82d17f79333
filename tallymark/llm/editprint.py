"""Document fingerprints by randomised edit embedding.

A walk reads a text from left to right. At step j it writes the character it stands on, and a random bit that
depends on j and that character alone decides whether it moves on. All texts share the random bits
[Chakraborty, Goldenberg, Koucky 2016], so two texts at a small edit distance fall into step again after an
edit and write almost the same string: edit distance becomes Hamming distance. A fingerprint keeps a sample of
what was written, one step of every 2^l; each level's steps are among those of the level below, and a text
takes the level that leaves it up to some 256 samples. So prints of texts of any length stay comparable,
on the steps of the coarser level, and take the same space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.arrow import map_blocks, row_blocks, text_columns
from tallymark.llm.components import connected_components
from tallymark.session import durable

SAMPLES = 256
SEED = 2016
TEXT_BYTES_PER_TASK = 16 << 20
MAX_TASKS = 1 << 16
BAND_SAMPLES = 8
_PERIOD = 1 << 14
_CHARS_AT_ONCE = 24 << 20
_COMPACT_STEPS = 128
_WALL = 0

_rng = np.random.default_rng(SEED)
# The random bits: one row of 256 character classes per step, used again after a period. Nothing leaves the wall.
_MOVES = _rng.integers(0, 2, (_PERIOD, 256)).astype(np.int64)
_MOVES[:, _WALL] = 0
_SYMBOLS = _rng.integers(0, 16, 256).astype(np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _bit(level: int, block: np.ndarray) -> np.ndarray:
    """Which half of a block holds the sample of ``level``."""
    x = block.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(np.int64)


def _levels(first: int, steps: int, most: int) -> list[int]:
    """The highest level, up to ``most``, at which each of ``steps`` steps from ``first`` is a sample."""
    at = np.arange(first, first + steps)
    kept, highest = np.ones(steps, bool), np.zeros(steps, np.int64)
    for level in range(1, most + 1):
        kept &= (at >> (level - 1) & 1) == _bit(level, at >> level)
        highest[kept] = level
    return highest.tolist()


def level_of(n_chars: int) -> int:
    """The lowest level at which a walk over so many characters, of two steps each on average, leaves at most 256 samples."""
    return max(0, (max(2 * n_chars, 1) - 1).bit_length() - SAMPLES.bit_length() + 1)


def embed(texts: Sequence[str]) -> list[tuple[int, np.ndarray]]:
    """``level, samples`` of every text: all walks go step by step together, in one array operation per step."""
    if not texts:
        return []
    levels = np.array([level_of(len(text)) for text in texts])
    order = np.argsort(levels, kind="stable")
    parts = []
    for n in order:
        codes = np.frombuffer(texts[n].encode("utf-32-le"), "<u4")
        classes = ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
        classes[classes == _WALL] = 1
        parts += [classes, np.zeros(1, np.uint8)]
    data = np.concatenate(parts)
    lengths = np.array([len(texts[n]) for n in order])
    at = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    lanes, lane_levels = order.copy(), levels[order]
    written = np.zeros((len(texts), 2 * SAMPLES), np.uint8)
    step, most = 0, int(levels.max())
    while len(lanes):
        groups = [(int(v), int(np.searchsorted(lane_levels, v)), int(np.searchsorted(lane_levels, v, "right"))) for v in np.unique(lane_levels)]
        for highest in _levels(step, _COMPACT_STEPS, most):
            classes = data[at]
            for level, first, last in groups:
                if level > highest:
                    break
                sample = step >> level
                if sample >= written.shape[1]:
                    written = np.pad(written, ((0, 0), (0, written.shape[1])))
                written[lanes[first:last], sample] = classes[first:last]
            at += _MOVES[step % _PERIOD][classes]
            step += 1
        walking = data[at] != _WALL
        if not walking.all():
            at, lanes, lane_levels = at[walking], lanes[walking], lane_levels[walking]
    counts = (written != _WALL).sum(axis=1)
    symbols = _SYMBOLS[written]
    return [(int(levels[n]), symbols[n, :counts[n]]) for n in range(len(texts))]


def to_text(print_: tuple[int, np.ndarray]) -> str:
    """Two hex digits of level, then one per sample."""
    return f"{print_[0]:02x}" + _HEX[print_[1]].tobytes().decode()


def from_text(text: str) -> tuple[int, np.ndarray]:
    return int(text[:2], 16), np.array([int(c, 16) for c in text[2:]], np.uint8)


def at_level(print_: tuple[int, np.ndarray], level: int) -> np.ndarray:
    """The samples that a print would have at a coarser level."""
    own, samples = print_
    while own < level:
        own += 1
        blocks = np.arange((len(samples) + 1) // 2)
        picked = 2 * blocks + _bit(own, blocks)
        samples = samples[picked[picked < len(samples)]]
    return samples


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The share of steps, of the longer walk, at which both wrote the same; two empty texts are alike."""
    level = max(a[0], b[0])
    x, y = at_level(a, level), at_level(b, level)
    longer, both = max(len(x), len(y)), min(len(x), len(y))
    return float((x[:both] == y[:both]).sum() / longer) if longer else 1.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` per input row; null text is empty and has a print without samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            prints = embed([row[1] for row in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(map(to_text, prints), pa.string())],
                names=["doc_id", "n_chars", "fingerprint"])

    return text_columns(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in as large lists as the bound on characters allows, since long walks cost the same for one or many texts."""
    held, size = [], 0
    for rows in row_blocks(batches):
        for row in rows:
            if held and size + len(row[1]) > _CHARS_AT_ONCE:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield held


def _dealt_by_id(docs: DataFrame) -> DataFrame:
    """``docs`` in partitions that follow each other by descending doc_id, each closed by the first row of the next.

    Cuts come from approximate quantiles, one per task. The closing rows (``guest`` 1) are one per task, found by
    their ids alone; the last partition is closed by the very first row. Texts are shuffled once.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(MAX_TASKS, max(1, -(-size // TEXT_BYTES_PER_TASK)))
    shares = [n / tasks for n in range(1, tasks)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else []
    cuts = np.array(cuts or [], np.int64)

    @F.pandas_udf("int")
    def place(ids):
        known = ids.notna().to_numpy()
        found = np.full(len(ids), len(cuts))
        found[known] = len(cuts) - np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64))
        return type(ids)(found)

    keyed = docs.withColumn("mixed", F.xxhash64("text")).withColumn("task", place("doc_id"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), F.col("doc_id").isNotNull().alias("k"), "mixed")
    firsts = [(r["task"], *r["f"]) for r in keyed.groupBy("task").agg(F.max(order).alias("f")).orderBy("task").collect()]
    guests = [(own[0], *after[1:]) for own, after in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    wanted = spark.createDataFrame(guests, "to int, i long, k boolean, m long")
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    closing = keyed.join(F.broadcast(wanted), (known == F.col("i")) & (F.col("doc_id").isNotNull() == F.col("k")) & (F.col("mixed") == F.col("m")))
    closing = closing.select("doc_id", "text", "mixed", F.col("to").alias("task"), F.lit(1).alias("guest")).dropDuplicates(["task"])
    both = keyed.withColumn("guest", F.lit(0)).unionByName(closing)
    return both.repartitionById(tasks, F.col("task")).sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), F.desc("mixed")).select("doc_id", "text", "guest")


def edited(text: str, after: str) -> str:
    """The last third of ``text`` (rounded down) replaced by as many characters from the start of ``after``, or all of them."""
    third = len(text) // 3
    return text[:len(text) - third] + after[:third]


def edit_prints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per input row.

    The next document is that with the next smaller doc_id; the first follows the last. Equal ids are ordered by the
    hash of their texts, null ids come last. Null text is empty.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pairs(rows: list[tuple], after: tuple | None) -> pa.RecordBatch | None:
        texts = [row[1] for row in rows] + ([after[1]] if after else [])
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = embed(texts + changed)
        own, other = prints[:len(texts)], prints[len(texts):]
        made = [
            (row[0], len(row[1]), hashlib.sha256(text.encode()).hexdigest(), to_text(p), to_text(e), likeness(p, e), likeness(p, n))
            for row, text, p, n, e in zip(rows, changed, own, own[1:], other)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names) if made else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for rows in _chunks(batches):
            if held and (made := pairs(held, rows[0])) is not None:
                yield made
            held = rows
        # The closing row has no successor here and is dropped, being another task's.
        if held and (made := pairs(held, None)) is not None:
            yield made

    return _dealt_by_id(text_columns(df, id_col, text_col)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_classes(df: DataFrame, min_likeness: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, class_id, n_links``: the smallest doc_id reachable over links between alike prints.

    Candidates share a band, eight samples in a row, at the same level; a print has bands at its own level and at the next
    coarser one, where prints of the adjoining length meet it. Equal prints are one. A band's prints link to the first of
    them, and a link counts if both prints' likeness is at least ``min_likeness``. Null and empty texts, whose prints
    have no samples, are one class; a null doc_id takes part but names no class.
    """
    docs = durable(fingerprints(df, id_col, text_col).select("doc_id", "fingerprint"))
    prints = docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))

    def band(rows: list[tuple]) -> list[tuple]:
        made = []
        for (text,) in rows:
            own = from_text(text)
            for level in (own[0], own[0] + 1):
                samples = at_level(own, level)
                for n in range(0, len(samples) - BAND_SAMPLES + 1, BAND_SAMPLES):
                    made.append((text, f"{level}.{n}." + _HEX[samples[n:n + BAND_SAMPLES]].tobytes().decode()))
        return made

    bands = map_blocks(prints.select("fingerprint"), band, "fingerprint string, band string")
    firsts = bands.groupBy("band").agg(F.min("fingerprint").alias("first"))
    pairs = bands.join(firsts, "band").where("fingerprint != first").select("fingerprint", "first").distinct()

    @F.pandas_udf("double")
    def alike(a, b):
        return type(a)([likeness(from_text(x), from_text(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    links = durable(pairs.where(alike("fingerprint", "first") >= min_likeness))
    roots = connected_components(links, "fingerprint", "first").withColumnsRenamed({"node": "fingerprint"})
    degree = links.select(F.explode(F.array("fingerprint", "first")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    placed = prints.join(roots, "fingerprint", "left").join(degree, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    by_print = placed.join(classes, "root").select("fingerprint", "class_id", "n_links")
    return docs.join(by_print, "fingerprint").select("doc_id", "fingerprint", "class_id", "n_links")
