"""Document fingerprints: a Merkle tree over chunks, paragraphs and sections.

A paragraph is a line; it is cut into chunks of some ten words at places that the letters before them
choose, so a chunk moves with its text. Sections are runs of paragraphs that end where a paragraph's hash
chooses. A chunk's hash is that of its bytes, and a higher node's hash that of its children's in order; the
root covers the text's bytes too. Equal texts have equal trees, and different roots are followed down
the branches that differ to the chunks that were edited.

As a string a tree is its root, then for each section its hash, for each paragraph its hash and those of its
chunks: ``root section paragraph chunk chunk; paragraph chunk| section ...`` (see :func:`write`).

Null counts as empty; an empty text has a tree without sections. Repeated rows have equal trees.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 8  # one blank of so many ends a chunk
SECTION = 8  # one paragraph of so many ends a section
MOST_RANGES = 1 << 14
DIGITS = 8  # hexadecimal digits of the hashes below the root

# A section: hash and paragraphs; a paragraph: hash and chunk hashes.
Paragraph = tuple[str, list[str]]
Section = tuple[str, list[Paragraph]]
Tree = tuple[str, list[Section]]


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _short(number: int) -> str:
    return f"{number >> (64 - 4 * DIGITS):0{DIGITS}x}"


def _cuts(data: bytes) -> np.ndarray:
    """Ends of chunks: after blanks that the four bytes before them choose."""
    letters = np.frombuffer(data, np.uint8)
    blanks = np.flatnonzero(letters == 32)
    blanks = blanks[blanks >= 4]
    mixed = np.zeros(len(blanks), np.uint32)
    for back in range(1, 5):
        mixed = (mixed + letters[blanks - back]) * np.uint32(0x9E3779B1)
    return blanks[(mixed >> np.uint32(16)) % CHUNK == 0] + 1


def tree(text: str | None) -> Tree:
    data = (text or "").encode()
    sections: list[Section] = []
    paragraphs: list[Paragraph] = []
    numbers: list[int] = []
    all_sections: list[int] = []

    def close():
        number = _hash(b"".join(n.to_bytes(8, "little") for n in numbers))
        sections.append((_short(number), paragraphs.copy()))
        all_sections.append(number)
        paragraphs.clear()
        numbers.clear()

    for line in data.split(b"\n") if data else []:
        ends = _cuts(line).tolist()
        if not ends or ends[-1] != len(line):
            ends.append(len(line))
        chunks = [_hash(line[s:e]) for s, e in zip([0, *ends], ends)]
        number = _hash(b"".join(c.to_bytes(8, "little") for c in chunks))
        paragraphs.append((_short(number), [_short(c) for c in chunks]))
        numbers.append(number)
        if number % SECTION == 0:
            close()
    if paragraphs:
        close()
    root = hashlib.sha256(b"".join(n.to_bytes(8, "little") for n in all_sections) + data).hexdigest()[:32]
    return root, sections


def write(tree: Tree) -> str:
    root, sections = tree
    return " ".join([root, "|".join(s + " " + ";".join(" ".join([p, *chunks]) for p, chunks in paragraphs)
                                    for s, paragraphs in sections)]).rstrip()


def read(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition(" ")
    sections = []
    for section in rest.split("|") if rest else []:
        name, _, paragraphs = section.partition(" ")
        sections.append((name, [(p.split(" ")[0], p.split(" ")[1:]) for p in paragraphs.split(";")]))
    return root, sections


def _apart(left: list, right: list) -> tuple[list, list]:
    """The branches of both that the other lacks, each as often as it is missing."""
    a, b = Counter(n for n, _ in left), Counter(n for n, _ in right)
    return _only(left, a - b), _only(right, b - a)


def _only(nodes: list, missing: Counter) -> list:
    missing = missing.copy()
    found = []
    for node in nodes:
        if missing[node[0]] > 0:
            missing[node[0]] -= 1
            found.append(node)
    return found


def likeness(left: str, right: str) -> float:
    """Share of chunks that two fingerprints have in common, 1 if the roots are equal.

    Only branches that differ are followed down.
    """
    return alike(read(left), read(right))


def alike(left: Tree, right: Tree) -> float:
    if left[0] == right[0]:
        return 1.0
    sizes = [sum(len(c) for _, ps in t[1] for _, c in ps) for t in (left, right)]
    a, b = _apart(left[1], right[1])
    a, b = _apart([p for _, ps in a for p in ps], [p for _, ps in b for p in ps])
    a, b = Counter(c for _, cs in a for c in cs), Counter(c for _, cs in b for c in cs)
    edited = sum((a - b).values()) + sum((b - a).values())
    return 1 - edited / sum(sizes) if sum(sizes) else 0.0


def edits(left: str, right: str) -> list[tuple[int, int]]:
    """Section and paragraph numbers of the left document in which it differs from the right one."""
    a, b = read(left), read(right)
    if a[0] == b[0]:
        return []
    known = Counter(n for n, _ in b[1])
    paragraphs = Counter(p for _, ps in b[1] for p, _ in ps)
    found = []
    for i, (name, own) in enumerate(a[1]):
        if known[name] > 0:
            known[name] -= 1
            continue
        for j, (p, _) in enumerate(own):
            if paragraphs[p] > 0:
                paragraphs[p] -= 1
            else:
                found.append((i, j))
    return found


@F.arrow_udf(T.StringType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([write(tree(t.as_py())) for t in texts], pa.string())


def fingerprint(text: Column) -> Column:
    return _fingerprint(text)


# Following documents ------------------------------------------------------------------------------------

def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COMPARED = T.StructType([
    T.StructField("n_chars", T.LongType()), T.StructField("edited_text", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: documents in order of range and id, each compared with the one after it."""
    held = None  # range, is it the range's own, id, text, tree
    names = ["doc_id", *COMPARED.fieldNames()]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows = []
        for range_, own, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            now = (range_, own, doc_id, text, tree(text) if own or held and held[1] and held[0] == range_ else None)
            if held and held[1] and held[0] == range_:
                changed = edited(held[3], text)
                other = tree(changed)
                rows.append((held[2], len(held[3]), changed, write(held[4]), write(other), alike(held[4], other),
                             alike(held[4], now[4])))
            held = now
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def compare_with_next(docs: DataFrame, per_range: int = 500) -> DataFrame:
    """Each document's fingerprint and text edited by means of the next, with both likenesses.

    The order is that of ids, null first, then of texts; the first document follows the last. Documents are dealt
    by ranges of ids, about ``per_range`` to a range and at most ``MOST_RANGES`` ranges, and the first of
    each range goes to the one before as well, so that every text travels once and is met in a stream.
    """
    ids = docs.select("doc_id")
    parts = min(MOST_RANGES, max(1, ids.count() // per_range))
    bounds = np.array(sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)))
                      if parts > 1 else [], np.int64)

    def range_of(found: pa.Array) -> np.ndarray:
        return np.where(found.is_null().to_numpy(zero_copy_only=False), 0,
                        np.searchsorted(bounds, found.fill_null(0).to_numpy(), side="right"))

    @F.arrow_udf(T.IntegerType())
    def number(found: pa.Array) -> pa.Array:
        return pa.array(range_of(found), pa.int32())

    # One row per range, and so a bounded number, comes to the driver.
    firsts = (ids.groupBy(number("doc_id").alias("range"))
              .agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("unnamed")).orderBy("range").collect())
    before = {None if r.unnamed else r.first: firsts[i - 1].range for i, r in enumerate(firsts)}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def numbers(found: pa.Array) -> pa.Array:
        return pa.array([[own] if doc_id not in before else [own, before[doc_id]]
                         for own, doc_id in zip(range_of(found).tolist(), found.to_pylist())], pa.list_(pa.int32()))

    dealt = (docs.select("doc_id", "text", numbers("doc_id").alias("ranges"))
             .select(F.posexplode("ranges").alias("at", "range"), "doc_id", "text")
             .select("range", (F.col("at") == 0).alias("own"), "doc_id", "text"))
    return (dealt.repartition("range")
            .sortWithinPartitions("range", F.col("own").desc(), F.col("doc_id").asc_nulls_first(), "text")
            .mapInArrow(_compare, T.StructType([T.StructField("doc_id", T.LongType()), *COMPARED.fields])))
