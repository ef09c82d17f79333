"""Token ids in length-delimited binary files, with a separate offset index.

One record per document: length (unsigned 64-bit), masked checksum of the length, payload, masked checksum
of the payload, one newline byte; all little-endian. The payload is a flag byte (1: the document has an id,
2: ids take four bytes instead of two), the doc_id and the token ids. The checksum is CRC-32, rotated and
offset so that a checksum of data that holds checksums stays good. Executors write through Spark's own file
committer, so a lost executor or a second attempt leaves no half file, and any store that Spark reaches will do.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.arrow import map_blocks, text_columns
from tallymark.llm.bpe import Memory, shipped

# Fixed values of the framing.
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_FOOT = struct.Struct("<I")
_PAYLOAD = struct.Struct("<Bq")

TEXT_BYTES_PER_FILE = 48 << 20


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record without its closing newline; ``ids`` are little-endian unsigned 32-bit integers."""
    values = np.frombuffer(ids, "<u4")
    wide = len(values) > 0 and int(values.max()) > 0xFFFF
    payload = _PAYLOAD.pack((doc_id is not None) | wide << 1, doc_id or 0) + (ids if wide else values.astype("<u2").tobytes())
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _FOOT.pack(masked_checksum(length)), payload, _FOOT.pack(masked_checksum(payload))))


def unframe(data: bytes, offset: int) -> tuple[int | None, np.ndarray, int]:
    """``doc_id, ids, length`` of the record at ``offset``; raises ValueError where a checksum or the end is wrong."""
    if offset + _HEAD.size > len(data):
        raise ValueError(f"record cut off at byte {offset}")
    length, check = _HEAD.unpack_from(data, offset)
    if masked_checksum(data[offset:offset + 8]) != check:
        raise ValueError(f"length checksum differs at byte {offset}")
    start = offset + _HEAD.size
    payload = data[start:start + length]
    end = start + length
    if len(payload) < length or data[end + 4:end + 5] != b"\n":
        raise ValueError(f"record cut off at byte {offset}")
    if masked_checksum(payload) != _FOOT.unpack_from(data, end)[0]:
        raise ValueError(f"payload checksum differs at byte {offset}")
    flags, doc_id = _PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_PAYLOAD.size).astype("<u4")
    return (doc_id if flags & 1 else None), ids, _HEAD.size + length + _FOOT.size + 1


class WordTokenizer:
    """A tokenizer whose pre-tokens never span white space, applied to each distinct piece between spaces and newlines once.

    The pieces' ids in order are the ids of the whole text, because the normalizer maps white space to single spaces and
    lower-cases, and the pre-tokenizer drops white space and parts letters from the marks that follow. So texts of ASCII
    and Latin-1 letters are lower-cased first and their marks set apart, which leaves fewer pieces. Pieces met before are
    remembered, up to a bound.
    """

    def __init__(self, model: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.encode_special_tokens = True
        self.pieces = Memory(_REMEMBERED)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(n) or "").endswith("</w>") for n in range(size)])

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        cut = [_pieces(text) for text in texts]
        known = self.pieces.ready(set().union(*cut), self._encode)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Pieces of letters alone are one pre-token each, so many go as one text and are told apart by their last ids."""
        words = [piece for piece in pieces if _LETTERS.fullmatch(piece)]
        texts = [" ".join(words[n:n + _WORDS_AT_ONCE]) for n in range(0, len(words), _WORDS_AT_ONCE)]
        made = [self._split(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known = dict(zip(words, (ids for own in made for ids in own), strict=True))
        others = [piece for piece in pieces if piece not in known]
        found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        known.update(zip(others, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True))
        return list(map(known.__getitem__, pieces))

    def _split(self, ids: list[int]) -> list[bytes]:
        values = np.array(ids, "<u4")
        data = values.tobytes()
        stops = (4 * (np.flatnonzero(self.ends_word[values]) + 1)).tolist()
        return [data[start:stop] for start, stop in zip([0, *stops], stops)]


_WORDS_AT_ONCE = 500
_LETTERS = re.compile(r"[a-z\xe0-\xf6\xf8-\xff]+")
_REMEMBERED = 400_000
_KEPT = 100_000
_BLOCK_BYTES = 4 << 20
_NOT_PLAIN = re.compile(r"[^\x00-\x7f\xc0-\xff]")
_MARKS_AFTER_LETTER = re.compile(r"(?<=[a-z\xe0-\xf6\xf8-\xff])([.,;:!?#$%&*|]+)(?= |\Z)")


def _pieces(text: str) -> list[str]:
    spaced = text.replace("\n", " ")
    if not _NOT_PLAIN.search(spaced):
        spaced = _MARKS_AFTER_LETTER.sub(r" \1", spaced.lower())
    return spaced.split(" ")


@functools.lru_cache(maxsize=1)
def _word_tokenizer(model: bytes) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    return WordTokenizer(model)


def write_records(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                  text_bytes_per_file: int = TEXT_BYTES_PER_FILE) -> None:
    """Encode every text, append ``end_id`` and write the records below ``path`` in ascending doc_id order.

    Files follow each other in that order, as do the records in them; rows without an id come first, rows with
    the same id go by the hash of their text, so that they can be spread as well. Null text is empty. The raw
    texts are dealt out by range, because they are smaller than their ids; then each task encodes its range.
    """
    model = shipped(df.sparkSession, tokenizer_path)
    end = struct.pack("<I", end_id)
    docs = text_columns(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // text_bytes_per_file))
    keyed = docs.withColumn("mixed", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(files, "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed").select("doc_id", "text")

    def block(rows: list[tuple]) -> list[tuple]:
        ids = _word_tokenizer(model.value).encode([text for _, text in rows])
        return [(frame(doc_id, own + end),) for (doc_id, _), own in zip(rows, ids, strict=True)]

    map_blocks(ordered, block, "record binary", lambda: _word_tokenizer(model.value).pieces.trim(_KEPT), _BLOCK_BYTES).select(F.col("record").cast("string")).write.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files, checked: ``file_no, doc_id, offset, length, n_tokens, start_in_file, ids_crc32``.

    This is the offset index once it is written; the texts' ids are not in it. A damaged record fails the job.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                number = int(re.search(r"part-(\d+)", batch.column(0)[n].as_py().rpartition("/")[2])[1])
                data = batch.column(1)[n].as_buffer().to_pybytes()
                rows, offset, start = [], 0, 0
                while offset < len(data):
                    doc_id, ids, length = unframe(data, offset)
                    rows.append((number, doc_id, offset, length, len(ids), start, zlib.crc32(ids.tobytes())))
                    offset, start = offset + length, start + len(ids)
                if rows:
                    kinds = [pa.int64()] * 7
                    names = ["file_no", "doc_id", "offset", "length", "n_tokens", "start_in_file", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(scan, "file_no long, doc_id long, offset long, length long, n_tokens long, start_in_file long, ids_crc32 long")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all records before this one. One window row per file, not per record."""
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("file_no").alias("base_no"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = index.join(bases, F.col("file_no") == F.col("base_no"))
    return joined.withColumn("start", F.col("base") + F.col("start_in_file")).drop("base_no", "base")


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``file_no, offset, doc_id, ids`` of the index rows ``wanted`` (``file_no, offset``), in any order or number.

    Offsets are gathered per file, of which there are as many as a file has records; other files are not opened.
    """
    spots = wanted.groupBy("file_no").agg(F.collect_list("offset").alias("offsets"))
    named = _files(spark, path).withColumn("file_no", F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long"))
    picked = named.join(spots, "file_no").select("file_no", "offsets", "content")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                number, data = batch.column(0)[n].as_py(), batch.column(2)[n].as_buffer().to_pybytes()
                found = [(number, offset, *unframe(data, offset)[:2]) for offset in batch.column(1)[n].as_py()]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["file_no", "offset", "doc_id", "ids"])

    return picked.mapInArrow(pick, "file_no long, offset long, doc_id long, ids array<long>")
