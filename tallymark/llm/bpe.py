"""Byte-level BPE over a rank file, with a hierarchical-bitmap queue for the merges.

A pre-token is a linked list of byte pieces. Every adjacent pair that the vocabulary can merge lies in
the bucket of its rank; three levels of 64-bit words say which buckets are filled, so find-first-set
gives the lowest rank in a fixed number of steps whatever the length. Popped entries whose pair has
changed since are stale and skipped. A pre-token of n bytes costs O(n log n) instead of the O(n^2) of
rescanning, which is what a megabyte without a space needs. Pre-tokens of a few bytes, nearly all of a text's, are merged
together instead: those of one length are the rows of a matrix, and every step merges the lowest pair of each row.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Callable, Iterable, Sequence
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tallymark.llm.arrow import map_blocks, text_columns

_REMEMBERED = 100_000
_KEPT = 20_000
_LONGEST_REMEMBERED = 64
_ID_BITS = 18
_SHORT = 32
_NO_RANK = 1 << _ID_BITS
_U4 = [struct.Struct(f"<{n}I").pack for n in range(64)]


class RankQueue:
    """Linked-list positions in one bucket per merge rank, under three levels of 64-bit words.

    ``pop`` finds the lowest filled bucket by three find-first-set steps and empties it. A drained queue
    is as good as new. Covers 2^18 ranks.
    """

    def __init__(self) -> None:
        self.top = 0
        self.middle = [0] * 64
        self.low = [0] * 4096
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Fill an empty bucket; further positions are appended to ``buckets[rank]``."""
        self.buckets[rank] = positions
        word, part = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.middle[part] |= 1 << (word & 63)
        self.top |= 1 << part

    def pop(self) -> tuple[int, list[int]] | None:
        top = self.top
        if not top:
            return None
        part = (top & -top).bit_length() - 1
        bits = self.middle[part]
        word = part << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.low[word] = bits = bits & bits - 1
        if not bits:
            self.middle[part] = bits = self.middle[part] & self.middle[part] - 1
            if not bits:
                self.top = top & top - 1
        return rank, self.buckets.pop(rank)


class BytePairEncoder:
    """Encoder and decoder of one vocabulary; remembers a bounded number of short pieces."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.queue = RankQueue()
        self.joined = {
            self.ranks[token[:at]] << _ID_BITS | self.ranks[token[at:]]: rank
            for token, rank in self.ranks.items() for at in range(1, len(token))
            if token[:at] in self.ranks and token[at:] in self.ranks
        }
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([self.joined.get(int(a) << _ID_BITS | int(b), -1) for a in self.byte_ids for b in self.byte_ids])
        pairs = np.array(sorted(self.joined.items()), np.int64).reshape(-1, 2)
        self.joined_keys, self.joined_ranks = np.append(pairs[:, 0], -1), np.append(pairs[:, 1], _NO_RANK)
        self.find = regex.compile(pattern).findall
        self.pieces, self.words = Memory(), Memory()

    def merge(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: each is merged lowest rank first, the leftmost of equal ones first."""
        lengths = np.array([len(word) for word in words], np.int64)
        ids: list[list[int]] = [[] for _ in words]
        for length in np.unique(lengths[(lengths > 0) & (lengths <= _SHORT)]).tolist():
            at = np.flatnonzero(lengths == length)
            text = np.frombuffer(b"".join([words[n] for n in at.tolist()]), np.uint8)
            self._merge_rows(at, text.reshape(len(at), length), ids)
        long = np.flatnonzero(lengths > _SHORT).tolist()
        for n, own in zip(long, self._merge_long([words[n] for n in long]), strict=True):
            ids[n] = own
        return ids

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _ID_BITS | right
        at = self.joined_keys[:-1].searchsorted(keys)
        return np.where(self.joined_keys[at] == keys, self.joined_ranks[at], _NO_RANK)

    def _merge_rows(self, at: np.ndarray, text: np.ndarray, ids: list[list[int]]) -> None:
        """Put the ids of pre-tokens of one length, the rows of ``text``, into ``ids`` at ``at``. Each step takes one pair of every row that has one."""
        parts = self.byte_ids[text]
        ranks = self.byte_pairs[text[:, :-1].astype(np.int64) << 8 | text[:, 1:]]
        ranks = np.where(ranks < 0, _NO_RANK, ranks)
        while ranks.shape[1]:
            place = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), place]
            done = least == _NO_RANK
            if done.any():
                for n, own in zip(at[done].tolist(), parts[done].tolist(), strict=True):
                    ids[n] = own
                at, parts, ranks, place, least = (a[~done] for a in (at, parts, ranks, place, least))
            rows, width = np.arange(len(at)), parts.shape[1]
            parts[rows, place] = least
            columns = np.arange(width - 1)
            parts = np.take_along_axis(parts, columns + (columns > place[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= place[:, None]), 1)
            behind, ahead = rows[place < width - 2], rows[place > 0]
            ranks[behind, place[behind]] = self._pair_ranks(least[behind], parts[behind, place[behind] + 1])
            ranks[ahead, place[ahead] - 1] = self._pair_ranks(parts[ahead, place[ahead] - 1], least[ahead])
        for n, own in zip(at.tolist(), parts.tolist(), strict=True):
            ids[n] = own

    def _merge_long(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of pre-tokens of any length. They lie in one linked list that is cut between them, so each is merged
        lowest rank first, the leftmost of equal ones first, while the queue is walked once for all.
        """
        rank_of, queue, buckets = self.joined.get, self.queue, self.queue.buckets
        text = np.frombuffer(b"".join(words), np.uint8)
        n = len(text)
        if n == 0:
            return [[] for _ in words]
        ends = np.cumsum([len(word) for word in words])
        links = np.arange(1, n + 1)
        links[ends[ends > 0] - 1] = -1
        after = links.tolist()
        links = np.arange(-1, n - 1)
        links[np.minimum(np.concatenate([[0], ends[:-1]]), n - 1)] = -1
        before = links.tolist()
        parts = self.byte_ids[text].tolist()
        ranks = np.full(n, -1)
        ranks[:-1] = self.byte_pairs[text[:-1].astype(np.int64) << 8 | text[1:]]
        ranks[ends[ends > 0] - 1] = -1
        pair = ranks.tolist()
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        cuts = np.flatnonzero(np.diff(ranks[order])) + 1
        for positions in np.split(order, cuts) if len(order) else ():
            queue.open(int(ranks[positions[0]]), positions.tolist())
        while (entry := queue.pop()) is not None:
            rank, bucket = entry
            bucket.sort()
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue
                j = after[i]
                after[i] = k = after[j]
                parts[i] = rank
                pair[j] = -1
                lower = False
                if k >= 0:
                    before[k] = i
                    pair[i] = new = rank_of(rank << _ID_BITS | parts[k], -1)
                    if new >= 0:
                        lower = new < rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.open(new, [i])
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    pair[h] = new = rank_of(parts[h] << _ID_BITS | rank, -1)
                    if new >= 0:
                        lower = lower or new < rank
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            queue.open(new, [h])
                if lower and at + 1 < len(bucket):  # a lower rank comes first; the rest waits
                    rest = bucket[at + 1:]
                    if rank in buckets:
                        buckets[rank] += rest
                    else:
                        queue.open(rank, rest)
                    break
        ids, start = [], 0
        for end in ends.tolist():
            own, i = [], start if end > start else -1
            while i >= 0:
                own.append(parts[i])
                i = after[i]
            ids.append(own)
            start = end
        return ids

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of texts, each as little-endian unsigned 32-bit integers.

        A single space between two other characters always begins a pre-token, so texts are cut there
        and pieces are looked up among those met before; a text with longer runs of white space is one
        piece. Both give the pre-tokens of the pattern over the whole text.
        """
        cut = []
        for text in texts:
            if _SPACES.search(text):
                cut.append([text])
            else:
                first, *rest = text.split(" ")
                cut.append(([first] if first else []) + [" " + piece for piece in rest] if text else [])
        pieces = self.pieces.ready(set().union(*cut), self._encode_pieces)
        return [b"".join(map(pieces.__getitem__, own)) for own in cut]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = [self.find(piece) for piece in pieces]
        words = self.words.ready(set().union(*found), self._encode_words)
        return [b"".join(map(words.__getitem__, own)) for own in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        raw = [word.encode() for word in words]
        whole = [self.ranks.get(word) for word in raw]
        merged = iter(self.merge([word for word, known in zip(raw, whole, strict=True) if known is None]))
        return [_U4[len(ids)](*ids) if len(ids := next(merged) if known is None else [known]) < len(_U4) else np.array(ids, "<u4").tobytes()
                for known in whole]

    def trim(self) -> None:
        """Give back most of what is remembered; called between tasks, as idle workers keep their memory."""
        self.pieces.trim()
        self.words.trim()

    def decode(self, ids: bytes | Iterable[int]) -> bytes:
        values = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        return b"".join(map(self.tokens.__getitem__, values))


_SPACES = regex.compile(r"[\s\x1c-\x1f]{2}")


class Memory:
    """What keys were turned into. When full, only what was used again since then stays; long keys never do."""

    def __init__(self, most: int = _REMEMBERED) -> None:
        self.most, self.known, self.older = most, {}, {}

    def trim(self, keep: int = _KEPT) -> None:
        """Keep the keys that came first, which the most frequent ones are among."""
        self.known, self.older = dict(islice(self.known.items(), keep)), {}

    def ready(self, keys: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A mapping that holds all ``keys``; valid until the next call."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = keys - known.keys()
        again = missing & older.keys() if older else ()
        for key in again:
            known[key] = older[key]
        missing = list(missing.difference(again))
        made = dict(zip(missing, make(missing), strict=True)) if missing else {}
        long = [key for key in made if len(key) > _LONGEST_REMEMBERED]
        known.update(made)
        if not long:
            return known
        whole = known
        self.known = {key: value for key, value in known.items() if len(key) <= _LONGEST_REMEMBERED}
        return whole


@functools.lru_cache(maxsize=2)
def encoder(rank_file: bytes, pattern: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary, so that its cache outlives a task."""
    return BytePairEncoder(rank_file, pattern)


def shipped(spark: SparkSession, path: str):
    """The bytes of a vocabulary file (a few MB, whatever the data) read on the driver and broadcast."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: one row per input row, ids as array of int. Null or empty text gives an empty array."""
    ranks = shipped(df.sparkSession, rank_path)

    def block(rows: list[tuple]) -> list[tuple]:
        ids = encoder(ranks.value, pattern).encode([text for _, text in rows])
        return [(doc_id, np.frombuffer(own, "<u4").astype("i4")) for (doc_id, _), own in zip(rows, ids, strict=True)]

    return map_blocks(text_columns(df, id_col, text_col), block, "doc_id long, ids array<int>", lambda: encoder(ranks.value, pattern).trim())


def decode_documents(df: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes``: the bytes of each id array, exactly those encoded. Null ids give empty bytes."""
    ranks = shipped(df.sparkSession, rank_path)
    columns = df.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{ids_col}` AS ids")

    def block(rows: list[tuple]) -> list[tuple]:
        decode = encoder(ranks.value, "").decode
        return [(doc_id, decode(ids or ())) for doc_id, ids in rows]

    return map_blocks(columns, block, "doc_id long, bytes binary")


def encoding_digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per input row, encoded and decoded in one pass over the texts.

    Null text is empty: no token and the digests of no bytes. Repeated rows give repeated rows.
    """
    ranks = shipped(df.sparkSession, rank_path)

    def block(rows: list[tuple]) -> list[tuple]:
        bpe = encoder(ranks.value, pattern)
        return [
            (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
            for (doc_id, _), ids in zip(rows, bpe.encode([text for _, text in rows]), strict=True)
        ]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_blocks(text_columns(df, id_col, text_col), block, schema, lambda: encoder(ranks.value, pattern).trim())
