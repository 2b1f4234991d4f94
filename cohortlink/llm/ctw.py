"""Language-model scores by context-tree weighting over bytes.

A text is the bytes of its words, A-Z lower-cased, with one space between and an end byte after; ends also
stand before it. Every byte is eight binary decisions, each with a context tree of its own whose branches are the
bytes before, up to ``DEPTH``. A node has the Krichevsky-Trofimov estimate of its counts, and from the root to
the deepest context known the estimates of all depths are mixed with the weights of context-tree weighting: a
node's own block probability against the product of its children's, half and half. A context without counts
adds nothing to the mix of its parent. The sum of the logarithms is the text's code length; per byte it is the
usual measure.

How it is spread over tasks: what a text contributes and needs are grams, a byte with the ``DEPTH`` before it,
packed in one number with the nearest byte in front. Tasks count the grams of their training texts; counts are
added up by the two nearest bytes, whose subtrees are then complete. Their sums go up to the two top levels of
the tree, at most 256 * 255 nodes, which are broadcast. To be scored, texts are dealt to blocks of some
megabytes; each block asks every subtree for its distinct grams and gets back logarithms in the same order.
The counts of words, for comparison with a unigram model, take the same way under 64-bit hashes of the words.

Null and empty texts are an end alone. Rows are scored each by itself, so ids may be null or repeated. Without
training texts every bit has probability one half. Only the columns of the result are returned.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH = 6  # bytes of context
SPLIT = 2  # nearest bytes that name a subtree
END = 10
WORD_PARTS = 10  # bits of a word's hash that name a part
FIRST_WORD_PART = 1 << 8 * SPLIT
END_WORD = b""
COUNTED = 1 << 21  # numbers a task gathers before it adds them up
BLOCK = 16 << 20  # bytes of text that ask together: the larger, the fewer grams are asked for twice
CHUNK = 2 << 20  # bytes of text turned into grams at once
SMOOTHING = 0.1
# Below its part a gram has so many bytes.
SUFFIX = DEPTH + 1 - SPLIT

PACKED = "part int, keys binary, counts binary"


# Texts to numbers ---------------------------------------------------------------------------------------

def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts in order, and how many each has."""
    joined = [b" ".join(words) for words in texts]
    pad, end = bytes([END]) * DEPTH, bytes([END])
    letters = np.frombuffer(b"".join(pad + j + end for j in joined), np.uint8)
    sizes = np.fromiter((len(j) + 1 for j in joined), np.int64, len(joined))
    keep = np.ones(len(letters), bool)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    # Two and four bytes, the last in front; of these a gram takes the bytes before it.
    two, four = letters.astype(np.uint16) << 8, np.zeros(len(letters), np.uint32)
    two[1:] |= letters[:-1]
    four[2:] = two[2:].astype(np.uint32) << 16 | two[:-2]
    keys = letters.astype(np.uint64)
    keys[1:] |= four[:-1].astype(np.uint64) << np.uint64(8 * (DEPTH - 3))
    keys[5:] |= two[:-5].astype(np.uint64) << np.uint64(8 * (DEPTH - 5))
    for back in range(1, DEPTH + 1):
        keep[starts + back - 1] = False
    return keys[keep], sizes


def word_keys(words) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begins], (np.diff(begins, append=len(keys)) if counts is None else np.add.reduceat(counts, begins))


class Sums:
    """Counts by key, added up whenever many are pending."""

    def __init__(self):
        self.held, self.pending, self.size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, counts))
        self.size += len(keys)
        if self.size > max(COUNTED, len(self.held[0])):
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if self.pending:
            parts = [self.held, *self.pending]
            self.held = tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            self.pending, self.size = [], 0
        return self.held


def gram_parts(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(8 * (DEPTH + 1 - SPLIT))).astype(np.int64)


def word_parts(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - WORD_PARTS)).astype(np.int64) + FIRST_WORD_PART


def cut(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal parts: part, begin and end."""
    begins = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else np.zeros(0, np.int64)
    return list(zip(parts[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(parts)]))


def packed(sums: tuple[np.ndarray, np.ndarray], parts: np.ndarray) -> pa.RecordBatch:
    """A row for each part; numbers take as few bytes as they need."""
    keys, counts = sums
    runs = cut(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _, _ in runs], pa.int32()), pa.array([pack_keys(keys[b:e], p) for p, b, e in runs], pa.binary()),
         pa.array([pack_counts(counts[b:e]) for _, b, e in runs], pa.binary())], ["part", "keys", "counts"])


def unpack(cell, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def planes(numbers: np.ndarray, width: int) -> bytes:
    """Whole numbers by their lowest bytes, one place after the other, which compresses well where they are small."""
    return np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(cell, width: int) -> np.ndarray:
    held = unpack(cell, np.uint8).reshape(width, -1)
    numbers = np.zeros((held.shape[1], 8), np.uint8)
    numbers[:, :width] = held.T
    return numbers.view("<u8").ravel()


def pack_keys(keys: np.ndarray, part: int) -> bytes:
    """Distinct keys of a part in order; of grams their steps below the part."""
    if part >= FIRST_WORD_PART:
        return keys.tobytes()
    return planes(np.diff(keys, prepend=np.uint64(part) << np.uint64(8 * SUFFIX)), SUFFIX)


def unpack_keys(cell, part: int) -> np.ndarray:
    if part >= FIRST_WORD_PART:
        return unpack(cell, np.uint64)
    return np.cumsum(from_planes(cell, SUFFIX), dtype=np.uint64) + (np.uint64(part) << np.uint64(8 * SUFFIX))


def pack_counts(counts: np.ndarray) -> bytes:
    most = int(counts.max()) if len(counts) else 0
    return planes(counts, max(1, -(-most.bit_length() // 8)))


def unpack_counts(cell, n: int) -> np.ndarray:
    return from_planes(cell, cell.as_buffer().size // n if n else 1).astype(np.int64)


def pack_values(values: np.ndarray) -> bytes:
    return planes(values.view(np.uint64), 8)


def unpack_values(cell) -> np.ndarray:
    return from_planes(cell, 8).view(float)


# Counting -----------------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: training texts to counts of grams and of words."""
    of_grams, of_words = Sums(), Counter()

    def out_words():
        keys = word_keys(of_words)
        sums = tally(keys, np.fromiter(of_words.values(), np.int64, len(of_words)))
        of_words.clear()
        return packed(sums, word_parts(sums[0]))

    for batch in batches:
        some, size = [], 0
        for text in batch.column(0):
            words = words_of(text.as_py())
            of_words.update(words)
            of_words[END_WORD] += 1
            some.append(words)
            size += len(text.as_py() or b"")
            if size > CHUNK:
                of_grams.add(*tally(grams(some)[0]))
                some, size = [], 0
            if len(of_words) > COUNTED // 8:
                yield out_words()
        if some:
            of_grams.add(*tally(grams(some)[0]))
        if len(of_grams.held[0]) > COUNTED:
            sums, of_grams = of_grams.close(), Sums()
            yield packed(sums, gram_parts(sums[0]))
    sums = of_grams.close()
    yield packed(sums, gram_parts(sums[0]))
    yield out_words()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: counts in order of parts to one row for each part."""
    part, sums = None, Sums()
    for batch in batches:
        for p, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if p != part:
                if part is not None:
                    done = sums.close()
                    yield packed(done, np.full(len(done[0]), part))
                part, sums = p, Sums()
            own = unpack_keys(keys, p)
            sums.add(own, unpack_counts(counts, len(own)))
    if part is not None:
        done = sums.close()
        yield packed(done, np.full(len(done[0]), part))


# The tree -----------------------------------------------------------------------------------------------

_TABLED = 1 << 14
_HALVES = np.concatenate(([math.lgamma(0.5)], math.lgamma(0.5) + np.cumsum(np.log(np.arange(_TABLED - 1) + 0.5))))
_WHOLES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_TABLED - 1) + 1.0))))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def _looked_up(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    found = table[np.minimum(n, _TABLED - 1)]
    large = np.flatnonzero(n >= _TABLED)
    found[large] = _log_gamma(n[large] + more)
    return found


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return (_looked_up(n0, _HALVES, 0.5) + _looked_up(n1, _HALVES, 0.5) - _looked_up(n0 + n1, _WHOLES, 1.0)
            - math.log(math.pi))


class Level:
    """The nodes of one depth and bit: keys of context and leading bits, counts, own weight and estimate of a one."""

    def __init__(self, keys, counts, bit: int):
        """``keys`` hold a context and a byte, in order."""
        symbol = keys & np.uint64(255)
        nodes = (keys >> np.uint64(8) << np.uint64(8)) | (symbol >> np.uint64(8 - bit))
        one = (symbol >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        new = np.concatenate(([True], nodes[1:] != nodes[:-1])) if len(nodes) else np.zeros(0, bool)
        begins = np.flatnonzero(new)
        self.keys, self.of = nodes[begins], np.cumsum(new) - 1  # nodes, and the node of each key
        empty = np.zeros(0, np.int64)
        self.n1 = np.add.reduceat(np.where(one, counts, 0), begins) if len(begins) else empty
        self.n0 = np.add.reduceat(np.where(one, 0, counts), begins) if len(begins) else empty
        self.settle(None)

    def settle(self, below: np.ndarray | None) -> None:
        """``below``: the logarithms of the children's products; none at the greatest depth."""
        block = log_block(self.n0, self.n1)
        self.log = block if below is None else np.logaddexp(block, below) - math.log(2)
        self.own = np.ones(len(block)) if below is None else 1 / (1 + np.exp(np.clip(below - block, -700, 700)))
        self.ones = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of nodes, and whether they are known."""
        places = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return places, (self.keys[places] == keys) if len(self.keys) else np.zeros(len(keys), bool)


def node_keys(keys: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """Nodes at a depth and bit on the way of grams."""
    symbol = keys & np.uint64(255)
    return (keys >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8)) | (symbol >> np.uint64(8 - bit))


class Subtree:
    """All nodes from the depth ``SPLIT`` down whose contexts begin with the same bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: list[list[Level]] = [[] for _ in range(DEPTH + 1)]
        self.keys, self.places = keys, [None] * (DEPTH + 1)
        symbol = keys & np.uint64(255)
        for depth in range(DEPTH, SPLIT - 1, -1):
            own, sums, place = keys, counts, np.arange(len(keys))
            if depth < DEPTH:
                own = (keys >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8)) | symbol
                own, place = np.unique(own, return_inverse=True)
                sums = np.bincount(place, counts, len(own)).astype(np.int64)
            self.places[depth] = place
            for bit in range(8):
                level = Level(own, sums, bit)
                if depth < DEPTH:
                    child = self.levels[depth + 1][bit]
                    parents = (child.keys >> np.uint64(16) << np.uint64(8)) | (child.keys & np.uint64(255))
                    level.settle(np.bincount(level.at(parents)[0], child.log, len(level.keys)))
                self.levels[depth].append(level)

    def ones(self, keys: np.ndarray, bit: int) -> np.ndarray:
        """Probability of a one at the depth ``SPLIT``; not a number where that node has no counts."""
        below = np.full(len(keys), np.nan)
        for depth in range(DEPTH, SPLIT - 1, -1):
            below = _mixed(self.levels[depth][bit], node_keys(keys, depth, bit), below)
        return below

    def own_ones(self, bit: int) -> np.ndarray:
        """The same for its own grams, whose nodes are all known."""
        below = None
        for depth in range(DEPTH, SPLIT - 1, -1):
            level = self.levels[depth][bit]
            at = level.of[self.places[depth]]
            below = level.ones[at] if below is None else level.own[at] * level.ones[at] + (1 - level.own[at]) * below
        return below


def _mixed(level: Level, nodes: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A level's estimate mixed with that from below; a level without counts passes on what is below."""
    if not len(level.keys):
        return below
    at, known = level.at(nodes)
    ones, own = level.ones[at], level.own[at]
    here = np.where(np.isnan(below), ones, own * ones + (1 - own) * below)
    return np.where(known, here, below)


class Top:
    """The levels above the subtrees, from sums by context, bit and leading bits."""

    def __init__(self, rows: list):
        self.levels: list[list[Level]] = []
        keys = np.array([r.node for r in rows], np.int64).astype(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        n0, n1, below = (np.array([getattr(r, c) for r in rows], float)[order] for c in ("n0", "n1", "log"))
        depth_bit = [(keys >> np.uint64(8)) & np.uint64(7), keys]
        for depth in range(SPLIT - 1, -1, -1):
            levels = []
            for bit in range(8):
                mine = depth_bit[0] == bit
                level = Level.__new__(Level)
                level.keys = (depth_bit[1][mine] >> np.uint64(16) << np.uint64(8)) | (depth_bit[1][mine] & np.uint64(255))
                level.n0, level.n1 = n0[mine].astype(np.int64), n1[mine].astype(np.int64)
                level.settle(below[mine])
                levels.append(level)
            self.levels.insert(0, levels)
            if depth:
                up_keys, up = [], []
                for bit, level in enumerate(levels):
                    parents = (level.keys >> np.uint64(16) << np.uint64(16)) | np.uint64(bit << 8) | (level.keys & np.uint64(255))
                    up_keys.append(parents)
                    up.append(np.stack((level.n0, level.n1, level.log)))
                all_keys, all_up = np.concatenate(up_keys), np.concatenate(up, axis=1)
                distinct, at = np.unique(all_keys, return_inverse=True)
                n0, n1, below = (np.bincount(at, row, len(distinct)) for row in all_up)
                depth_bit = [(distinct >> np.uint64(8)) & np.uint64(7), distinct]

    def ones(self, keys: np.ndarray, bit: int, below: np.ndarray) -> np.ndarray:
        for depth in range(SPLIT - 1, -1, -1):
            below = _mixed(self.levels[depth][bit], node_keys(keys, depth, bit), below)
        return np.where(np.isnan(below), 0.5, below)


def log10s(keys: np.ndarray, subtree: Subtree, top: Top, own: bool = False) -> np.ndarray:
    """Logarithms of the probabilities of grams' bytes; ``own`` when they are the subtree's grams themselves."""
    total = np.zeros(len(keys))
    for bit in range(8):
        ones = top.ones(keys, bit, subtree.own_ones(bit) if own else subtree.ones(keys, bit))
        one = (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        total += np.log10(np.where(one, ones, 1 - ones))
    return total


def _roll_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: a subtree's counts to sums for its parents; a node is context, bit and leading bits in one number."""
    for batch in batches:
        nodes, columns = [], []
        for part, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            own = unpack_keys(keys, part)
            for bit, level in enumerate(Subtree(own, unpack_counts(counts, len(own))).levels[SPLIT]):
                nodes.append((level.keys >> np.uint64(16) << np.uint64(16)) | np.uint64(bit << 8) | (level.keys & np.uint64(255)))
                columns.append(np.stack((level.n0, level.n1, level.log)))
        if nodes:
            n0, n1, log = np.concatenate(columns, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).astype(np.int64)), pa.array(n0), pa.array(n1),
                                              pa.array(log)], ["node", "n0", "n1", "log"])


class Model:
    """The counts by part, the top of the tree, and totals of words."""

    def __init__(self, counts: DataFrame, top: Top, tokens: int, distinct: int):
        self.counts, self.top, self.tokens, self.distinct = counts, top, tokens, distinct


def learn(texts: DataFrame) -> Model:
    """The model of a table with one column of texts, all of them."""
    counted = texts.toDF("text").select(F.col("text").cast("binary")).mapInArrow(_count, PACKED)
    counts = stored(counted.repartition("part").sortWithinPartitions("part").mapInArrow(_add, PACKED))
    rolled = (counts.where(F.col("part") < FIRST_WORD_PART).mapInArrow(_roll_up, "node long, n0 double, n1 double, log double")
              .groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log")]))
    # At most 256 contexts of one byte with 255 nodes each.
    top = Top(rolled.collect())

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [unpack_counts(c, len(unpack(k, np.uint64))) for k, c in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array([int(o.sum()) for o in own], pa.int64()),
                                              pa.array([len(o) for o in own], pa.int64())], ["tokens", "words"])
    row = (counts.where(F.col("part") >= FIRST_WORD_PART).mapInArrow(totals, "tokens long, words long")
           .agg(F.sum("tokens"), F.sum("words")).first())
    return Model(counts, top, row[0] or 0, row[1] or 0)


# Scoring ------------------------------------------------------------------------------------------------

def _chunks(texts: Iterable[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of texts, some megabytes of text at a time."""
    some, size = [], 0
    for text in texts:
        some.append(words_of(text))
        size += len(text or b"")
        if size > CHUNK:
            ready, some, size = some, [], 0
            yield ready
            del ready
    if some:
        yield some


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct keys of some lists, in order."""
    keys = np.sort(np.concatenate(parts), kind="stable")  # which merges what is in order
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: texts in order of blocks to each block's distinct grams and words by part."""
    block, some, size, keys, words = None, [], 0, [], {END_WORD}

    def take():
        nonlocal some, size
        if some:
            keys.append(tally(grams(some)[0])[0])
            words.update(chain.from_iterable(some))
        some, size = [], 0

    def out():
        nonlocal keys, words
        take()
        distinct, hashes = _merged(keys), _merged([word_keys(words)])
        keys, words = [], {END_WORD}
        runs = [(p, distinct[b:e]) for p, b, e in cut(gram_parts(distinct))] + [(p, hashes[b:e]) for p, b, e in cut(word_parts(hashes))]
        return pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in runs], pa.int32()), pa.array([block] * len(runs), pa.int32()),
            pa.array([pack_keys(k, p) for p, k in runs], pa.binary())],
            ["part", "block", "keys"])

    for batch in batches:
        for b, text in zip(batch.column("block").to_pylist(), batch.column("text")):
            if b != block:
                if block is not None:
                    yield out()
                block = b
            some.append(words_of(text.as_py()))
            size += len(text.as_py() or b"")
            if size > CHUNK:
                take()
    if block is not None:
        yield out()


def _answer(top):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task code: each part's counts, then what blocks ask of it, to values in the order asked."""
        part, own, known, subtree = None, None, None, None
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            parts, blocks, values = [], [], []
            for p, block, keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                keys = unpack_keys(keys, p)
                if p != part:
                    part, own, known = p, *nothing
                    subtree = Subtree(*nothing) if p < FIRST_WORD_PART else None
                if block < 0:
                    own, known = keys, unpack_counts(n, len(keys))
                    if subtree:
                        subtree = Subtree(own, known)
                        known = log10s(own, subtree, top.value, own=True)
                    continue
                found, at, seen = np.zeros(len(keys)), np.zeros(0, np.int64), np.zeros(len(keys), bool)
                if len(own):
                    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                    seen = own[at] == keys
                    found[seen] = known[at[seen]]
                if subtree and not seen.all():
                    found[~seen] = log10s(keys[~seen], subtree, top.value)
                parts.append(p)
                blocks.append(block)
                values.append(pack_values(found))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.int32()),
                                              pa.array(values, pa.binary())], ["part", "block", "values"])
    return work


def _score(tokens: int, distinct_words: int):
    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Task code: a block's texts and the answers to it to the scores of its texts."""
        own = {p: v for p, v in zip(answers.column("part").to_pylist(), answers.column("values"))}
        values = np.concatenate([unpack_values(own[p]) for p in sorted(own) if p < FIRST_WORD_PART])
        # Of each chunk its distinct grams, how often each occurs and in which texts; then the block's distinct grams, which were asked for.
        distinct, times, places, sizes = [], [], [], []
        number: defaultdict = defaultdict(count().__next__)  # words in order of their first occurrence
        of_words, n_words = [np.array([number[END_WORD]], np.int32)], []
        for some in _chunks(t.as_py() for t in docs.column("text")):
            keys, size = grams(some)
            order = np.argsort(keys)
            keys = keys[order]
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            distinct.append(keys[begins])
            times.append(np.diff(begins, append=len(keys)).astype(np.int32))
            places.append(np.repeat(np.arange(len(some), dtype=np.min_scalar_type(len(some))), size)[order])
            sizes.append(size)
            n_words += [len(words) for words in some]
            of_words.append(np.fromiter(map(number.__getitem__, chain.from_iterable(some)), np.int32))
            del some, keys, order, begins  # before the next chunk is made
        asked, score = _merged(distinct), []
        for keys, n, place, size in zip(distinct, times, places, sizes):
            score.append(np.bincount(place, np.repeat(values[np.searchsorted(asked, keys)], n), len(size)))
        hashes = word_keys(number)
        counts = np.concatenate([unpack_values(own[p]) for p in sorted(own) if p >= FIRST_WORD_PART])
        counts = counts[np.searchsorted(_merged([hashes]), hashes)]
        logs = np.log10(counts + SMOOTHING) - math.log10(tokens + SMOOTHING * (distinct_words + 1))
        # The end of a text, word 0, counts as its last word.
        begins = np.cumsum(n_words) - n_words
        words = np.insert(np.concatenate(of_words)[1:], begins + n_words, 0)
        begins, n_tokens = begins + np.arange(len(begins)), np.array(n_words, np.int64) + 1
        base = np.add.reduceat(logs[words], begins)
        known = np.add.reduceat((counts > 0)[words].astype(np.int64), begins)
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.concatenate(sizes)), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * len(base), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(score))})
    return work


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each of ``docs (doc_id, text)``: ``n_bytes``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``score`` is the text's log10 probability, ``base_score`` that under the smoothed unigram model.
    """
    spark = docs.sparkSession
    whole = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = 1 + whole // BLOCK
    # Dealt once, for the questions and for the scores: both sides read the same shuffle, so neither drops a column of it.
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id",
                        F.col("text").cast("binary").alias("text")).repartition("block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(_ask, "part int, block int, keys binary")
    # A part that very many blocks ask is answered in several places.
    places = 1 + blocks // 512
    known = model.counts.select("part", F.lit(-1).alias("block"), "keys", "counts",
                                F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"))
    both = known.unionByName(asked.select("part", "block", "keys", F.lit(None).cast("binary").alias("counts"),
                                          (F.col("block") % places).cast("int").alias("place")))
    top = spark.sparkContext.broadcast(model.top)
    answers = (both.repartition("part", "place").sortWithinPartitions("part", "place", "block")
               .select("part", "block", "keys", "counts").mapInArrow(_answer(top), "part int, block int, values binary"))
    return (dealt.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(_score(model.tokens, model.distinct),
                          "doc_id long, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def bits_per_byte(score: Column, n_bytes: Column) -> Column:
    """Code length per byte."""
    return -score / math.log10(2) / n_bytes
