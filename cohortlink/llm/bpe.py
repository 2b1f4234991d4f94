"""Byte-pair encoding of texts with the merges of a given vocabulary, and decoding.

A text is cut at special tokens and then by the vocabulary's pattern. Every piece starts as a doubly linked
list of its bytes; a priority queue holds the ranks of the merges between neighbours, and the best is applied
until none is left. A merge leaves entries in the queue that have gone stale, which are skipped when they
come up. So a piece of n bytes takes n log n steps, however long it is. Pieces met before are looked up.
Decoding puts the vocabulary's strings of the ids one after the other.

Ids are unsigned 32-bit numbers, little-endian, in a binary column. Null and empty texts have no ids; null ids
decode to an empty text. Rows are encoded each by itself, so repeated rows and other columns do not matter. The vocabulary, some ten thousand entries of fixed number, is read on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pattern that cuts a text before byte-level merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KNOWN_PIECES = 1 << 18  # pieces a task remembers, some 60 MB
WIDE = 32


def letters_of_bytes() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks and token bytes of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        ids = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        to_byte = {letter: b for b, letter in enumerate(letters_of_bytes())}
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in ids.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.first = [ids[letter] for letter in letters_of_bytes()]
        # Pair of ids in one number -> rank and id of what they become, in one number.
        self.merges = {ids[a] << WIDE | ids[b]: rank << WIDE | ids[a + b]
                       for rank, (a, b) in enumerate(told["model"]["merges"])}


def merged(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one piece."""
    ids = [vocabulary.first[b] for b in piece]
    n, merges = len(ids), vocabulary.merges
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    # An entry holds rank, place of the left symbol, and its id: equal ranks go from left to right.
    queue = []
    for i in range(n - 1):
        found = merges.get(ids[i] << WIDE | ids[i + 1])
        if found is not None:
            queue.append((found >> WIDE, i))
    heapq.heapify(queue)
    while queue:
        rank, left = heapq.heappop(queue)
        right = after[left]
        if ids[left] < 0 or right >= n:
            continue
        found = merges.get(ids[left] << WIDE | ids[right])
        if found is None or found >> WIDE != rank:
            continue
        ids[left], ids[right] = found & 0xFFFFFFFF, -1
        after[left] = following = after[right]
        if following < n:
            before[following] = left
            found = merges.get(ids[left] << WIDE | ids[following])
            if found is not None:
                heapq.heappush(queue, (found >> WIDE, left))
        previous = before[left]
        if previous >= 0:
            found = merges.get(ids[previous] << WIDE | ids[left])
            if found is not None:
                heapq.heappush(queue, (found >> WIDE, previous))
    return [i for i in ids if i >= 0]


class Encoder(dict):
    """Packed ids of pieces; a piece not met before is merged. At most ``KNOWN_PIECES`` are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.find = regex.compile(PIECES).findall
        self.special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(vocabulary.special, key=len, reverse=True))
                                     ) if vocabulary.special else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        packed = array("I", merged(piece.encode(), self.vocabulary))
        if sys.byteorder == "big":
            packed.byteswap()
        packed = packed.tobytes()
        if len(piece) < 64:
            self[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return b"".join(map(self.__getitem__, self.find(text)))
        parts = []
        for part in self.special.split(text):
            known = self.vocabulary.special.get(part) if part else None
            parts.append(known.to_bytes(4, "little") if known is not None
                         else b"".join(map(self.__getitem__, self.find(part or ""))))
        return b"".join(parts)


def decoded(ids: bytes | None, vocabulary: Vocabulary) -> str:
    numbers = np.frombuffer(ids or b"", "<u4").tolist()
    return b"".join(map(vocabulary.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


def encode(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function from a column of texts to one of ids; ``path`` is the tokenizer's file."""
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))

    @F.arrow_udf(T.BinaryType())
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Encoder(vocabulary.value).encode
        for texts in batches:
            yield pa.array([of(t.as_py()) for t in texts], pa.binary())
    return ids_of


def decode(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function from a column of ids to one of texts."""
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))

    @F.arrow_udf(T.StringType())
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary.value
        for ids in batches:
            yield pa.array([decoded(i.as_py(), words) for i in ids], pa.string())
    return text_of


def n_tokens(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")
