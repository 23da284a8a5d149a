"""Byte-level BPE: merges picked from a rank queue kept as a hierarchical bitmap.

A pre-token is a doubly linked list of symbols.  Every adjacent pair that has a
merge rank waits in the bucket of that rank, in a heap of list positions.  The
ranks with a non-empty bucket are bits of a three-level bitmap; find-first-set
walks from the top word to the lowest rank, so the next merge costs the same
however long the pre-token is.  An entry whose pair has changed meanwhile is stale and
is skipped when it comes up.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable
from heapq import heappop, heappush

import regex
from pyspark.sql import DataFrame, functions as F

from muonloom.llm.common import as_bytes, map_rows

#: The first so many words and pre-tokens of at most CACHED_CHARS characters are remembered per worker.
CACHED_CHARS, CACHED_WORDS, CACHED_PIECES = 40, 300_000, 800_000


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


#: Bits of a bitmap word, and the words with one bit.
BITS = 256
BIT = [1 << i for i in range(BITS)]


class Encoder:
    """Ids of texts by merge ranks.  Every single byte has a rank, so every text has ids."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.ranks = dict(ranks)
        self.token = {rank: token for token, rank in ranks}
        self.split = regex.compile(pattern)
        # a space before something else than white space always begins a pre-token, so texts are cut there
        self.cut = regex.compile(r" (?=\S)")
        self.odd_space = regex.compile(r" (?:\s|$)")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, text: bytes) -> list[int]:
        """Ids of one pre-token: the lowest rank merges first, leftmost first among equals."""
        rank_of = self.ranks.get
        whole = rank_of(text)
        if whole is not None:
            return [whole]
        n = len(text)
        # the symbol at i covers text[i:end[i]]; left[i] is the start of the one before it
        end = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the symbol at i with the next one
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0  # upper level: which words have a bit

        for i in range(n - 1):
            r = rank_of(text[i:i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so still a heap
                else:
                    buckets[r] = [i]
                    hi = r >> 8
                    words[hi] = words.get(hi, 0) | BIT[r & 255]
                    top |= 1 << hi
        while top:
            hi = (top & -top).bit_length() - 1  # find first set, level by level
            word = words[hi]
            low = word & -word
            rank = hi << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[hi] = word = word ^ low
                if not word:
                    top ^= 1 << hi
            if pair[i] != rank:
                continue  # stale: the pair has changed since
            middle = end[i]
            end[i] = stop = end[middle]
            pair[middle] = pair[i] = -1
            changed = ()
            if stop < n:
                left[stop] = i
                r = rank_of(text[i:end[stop]])
                if r is not None:
                    pair[i] = r
                    changed = ((r, i),)
            before = left[i]
            if before >= 0:
                r = rank_of(text[before:stop])
                if r is None:
                    pair[before] = -1
                elif r != pair[before]:
                    pair[before] = r
                    changed += ((r, before),)
            for r, at in changed:
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    hi = r >> 8
                    words[hi] = words.get(hi, 0) | BIT[r & 255]
                    top |= 1 << hi
        out, i = [], 0
        while i < n:
            out.append(self.ranks[text[i:end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> bytes:
        """Packed ids of a pre-token."""
        known = self.pieces.get(text)
        if known is None:
            known = little_endian(array("I", self.merge(text.encode())))
            if len(text) <= CACHED_CHARS and len(self.pieces) < CACHED_PIECES:
                self.pieces[text] = known
        return known

    def part(self, text: str) -> bytes:
        """Packed ids of a text between two cuts."""
        return b"".join(map(self.piece, self.split.findall(text)))

    def word(self, text: str) -> bytes:
        """Packed ids of a word with a space before it."""
        ids = self.part(" " + text)
        if len(text) <= CACHED_CHARS and len(self.words) < CACHED_WORDS:
            self.words[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.odd_space.search(text):
            first, *rest = self.cut.split(text)
        else:
            first, *rest = text.split(" ")
        ids = list(map(self.words.get, rest))
        for i, known in enumerate(ids):
            if known is None:
                ids[i] = self.word(rest[i])
        return self.part(first) + b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, from_little_endian(ids)))


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def from_little_endian(data: bytes) -> array:
    ids = array("I")
    ids.frombytes(data)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def _per_worker(df: DataFrame, path: str, pattern: str) -> Callable[[], Encoder]:
    """The ranks (a vocabulary file, about 1 MB) go to the workers as a broadcast.

    A worker that runs several tasks keeps the broadcast value, and on it the
    encoder with the words it knows.
    """
    sent = df.sparkSession.sparkContext.broadcast({"ranks": read_ranks(path)})

    def make() -> Encoder:
        kept = sent.value
        if "encoder" not in kept:
            kept["encoder"] = Encoder(kept["ranks"], pattern)
        return kept["encoder"]

    return make


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids): ids as little-endian unsigned 32-bit integers, without special tokens.

    ``path`` is a rank file the driver can read.  One row per input row, so
    repeated rows give repeated results; null text and empty text have no ids;
    null keys stay; other columns are ignored.  A pre-token of any length costs
    time in proportion to its length times the bitmap's three levels.
    """
    make = _per_worker(docs, path, pattern)
    kind = docs.schema[key].dataType.simpleString()

    def start():
        encoder = make()

        def one(row):
            ids = encoder.encode(row["text"].decode("utf-8", "replace"))
            return [{"key": row["key"], "n_tokens": len(ids) // 4, "ids": ids}]

        return one

    rows = docs.select(F.col(key).alias("key"), as_bytes(text).alias("text"))
    return map_rows(rows, f"key {kind}, n_tokens long, ids binary", start).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Add ``decoded``, the bytes that the ids stand for."""
    make = _per_worker(encoded, path, ".")
    kind = encoded.schema[key].dataType.simpleString()

    def start():
        encoder = make()

        def one(row):
            return [row | {"decoded": encoder.decode(row["ids"])}]

        return one

    rows = encoded.select(F.col(key).alias("key"), "n_tokens", "ids")
    return map_rows(rows, f"key {kind}, n_tokens long, ids binary, decoded binary", start) \
        .withColumnRenamed("key", key)
