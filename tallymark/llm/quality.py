"""Quality rules: base counts and the divergence of a document from the corpus in its language.

Two histograms are taken of every text: of character classes, and of common words (with all other words
in one bin). The references are the summed histograms of all documents in the same language. A document
whose Jensen-Shannon distance from a reference is too large is rejected, if it is long enough for the
distance to say something.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.arrow import map_blocks, row_blocks, text_columns
from tallymark.session import durable

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that it for on was as with by at from this are be an or which he not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en un du une que est pour qui dans par sur au avec "
    "el y a los se del las por con no para es lo su"
).split()

# Character classes by UTF-8 byte; the last class holds every other byte, such as those of accented letters.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\v\f", b".,;:?'\"-()", b"!", b"#*$%&|<>")
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_BYTES_FOR_CLASSES = 300
MIN_WORDS_FOR_WORDS = 120
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.32
MAX_LANGUAGES = 1000

_class_of = np.full(256, len(_CLASSES), np.uint8)
for _n, _chars in enumerate(_CLASSES):
    _class_of[list(_chars)] = _n
_word_bin = {word.encode(): n for n, word in enumerate(dict.fromkeys(COMMON_WORDS))}
CLASS_BINS = len(_CLASSES) + 1
WORD_BINS = len(_word_bin) + 1


def repeated_window_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of ``width`` words found at least twice, the first occurrence included.

    Windows are numbered by sorting pairs of shorter windows' numbers, so equality is exact and memory is
    a few integers per word.
    """
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    windows = ids
    for _ in range(width - 1):
        follow = ids[len(ids) - len(windows) + 1:]
        windows = np.unique(windows[:-1] * len(numbers) + follow, return_inverse=True)[1]
    found_again = np.bincount(windows)[windows] > 1
    if not found_again.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k:k + len(found_again)] |= found_again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    raw = text.encode()
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def histograms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes (over UTF-8 bytes) and of common words (ASCII lower-cased, edge punctuation stripped)."""
    raw = text.encode()
    classes = np.zeros(CLASS_BINS, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for start in range(0, len(data), 1 << 20):
        classes += np.bincount(_class_of[data[start:start + (1 << 20)]], minlength=CLASS_BINS)
    words = _EDGE.sub(b" ", raw.lower()).split()
    found = list(filter(None.__ne__, map(_word_bin.get, words)))
    common = np.bincount(np.array(found, np.int64), minlength=WORD_BINS)
    common[-1] = len(words) - len(found)
    return classes, common


_EDGE = re.compile(rb"[.,;:?](?=[\x20\x09-\x0D]|\Z)")


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 0 if either is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    part = sum(float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0]))) for x in (p, q))
    return float(np.sqrt(max(part, 0.0) / 2))


def language_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Summed histograms per language over every document; null is a language of its own.

    Each task sends one row per language and block, a partial aggregate adds them up, and the driver gets
    one row for each of at most ``MAX_LANGUAGES`` languages, the most frequent ones. Documents of any other
    language are compared with the sum over all documents, kept under the key ``"*"``.
    """
    columns = text_columns(df.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")), "id", "t", F.col("l").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_blocks(batches):
            sums: dict[str | None, np.ndarray] = {}
            for _, text, lang in rows:
                own = np.concatenate([[1], *histograms(text)])
                sums[lang] = sums[lang] + own if lang in sums else own
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    size = 1 + CLASS_BINS + WORD_BINS
    counted = columns.mapInArrow(count, "lang string, counts array<long>")
    totals = [F.sum(F.col("counts")[n]).alias(f"c{n}") for n in range(size)]
    per_language = durable(counted.groupBy("lang").agg(*totals))
    sums = [F.sum(f"c{n}").alias(f"c{n}") for n in range(size)]
    overall, languages = per_language.agg(*sums).first(), per_language.orderBy(F.desc("c0"), "lang").limit(MAX_LANGUAGES).collect()
    split = lambda row: np.split(np.array([row[f"c{n}"] or 0 for n in range(1, size)]), [CLASS_BINS])
    return {"*": tuple(split(overall)), **{("lang", row["lang"]): tuple(split(row)) for row in languages}}


def judge(text: str, lang: str | None, references: dict) -> tuple:
    """Base counts, ``base_failed``, both distances and ``kept`` of one text."""
    counts = base_counts(text)
    failed = base_failed(counts[0], counts[4])
    classes, common = histograms(text)
    near = [references["*"], references.get(("lang", lang), references["*"])]
    d_class, d_word = min(js_distance(classes, r[0]) for r in near), min(js_distance(common, r[1]) for r in near)
    far = classes.sum() >= MIN_BYTES_FOR_CLASSES and d_class > MAX_CLASS_DISTANCE
    far = far or (counts[0] >= MIN_WORDS_FOR_WORDS and d_word > MAX_WORD_DISTANCE)
    return (*counts, failed, d_class, d_word, not failed and not far)


_VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "class_distance double, word_distance double, kept boolean"
)


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id`` with base counts, distances and ``kept``, one row per input row.

    Null or empty text has no word and fails the base rule. Below the minimum lengths a distance is
    reported but does not count. Ties and repeated rows are judged alike.
    """
    references = language_references(df, text_col, lang_col)

    def block(rows: list[tuple]) -> list[tuple]:
        return [(doc_id, *judge(text, lang, references)) for doc_id, text, lang in rows]

    return map_blocks(text_columns(df, id_col, text_col, F.col(f"`{lang_col}`").cast("string").alias("lang")), block, f"doc_id long, {_VERDICT}")


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that the verdict keeps, with all their columns; one pass for references, one to filter."""
    references = language_references(df, text_col, lang_col)

    names = df.columns
    at, by = names.index(text_col), names.index(lang_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts, langs = part.column(at).to_pylist(), part.column(by).cast(pa.string()).to_pylist()
                yield part.filter(pa.array([judge(text or "", lang, references)[-1] for text, lang in zip(texts, langs, strict=True)], pa.bool_()))

    return df.mapInArrow(kept, df.schema)
