"""Near duplicates by SimHash, found by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; a bit is set where it is set in over half the XXH64 hashes of the text's word
shingles. Two fingerprints at a distance of at most ``radius`` bits have a common point within half of it
from both. So every distinct fingerprint emits all points of that ball, the points are shuffled, and
fingerprints that meet in a point are verified and linked. In a point's group each is linked to the
smallest only: all of them lie within the radius of each other, so no link between components is lost,
and a group gives as many links as it has members.

The ball of radius 2 has 2081 points. They travel in packed arrays, one per block of fingerprints and
bucket of the point space: a point is multiplied by an odd constant, its leading bits name the bucket, and
the rest shares a 64-bit word with the number of the flipped bits, from which the fingerprint follows.
The buckets are worked through in ``passes``, each with a shuffle of its own, so that only a part of the
points is on disk at a time. Copies are one fingerprint, so no bucket is hot.

Null and wordless texts have fingerprint zero and are linked like any other. A null id is never the
smallest unless all are null. Repeated rows share a component. Empty tables give empty results. Input
columns named like a result are replaced; the others pass through.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SEED = 42
# Spreads points over the buckets; odd, so it can be undone.
SPREAD = 0x9E3779B97F4A7C15
FLIP_BITS = 11
BLOCK = 1024  # fingerprints whose points are made at a time
HELD = 1 << 20  # links a task holds before it passes them on


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size]))
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[size - 1:] - 1).tolist())),
                       np.uint64, len(words) - size + 1)


def fingerprint_of(text: bytes | None, size: int = 4) -> int:
    """SimHash of a text in UTF-8, as a signed 64-bit number; A-Z are lower-cased first."""
    hashes = shingle_hashes(text or b"", size)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = 4) -> Column:
    """SimHash of a text column, as a signed 64-bit number."""
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")
    return of(text.cast("binary"))


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def flips(half: int) -> np.ndarray:
    """All words with at most ``half`` of 64 bits set."""
    return np.array([sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(BITS), k)],
                    np.uint64)


def _points(half: int, bucket_bits: int, first: int, last: int):
    """Task code: blocks of fingerprints to packed points of the buckets from ``first`` up to ``last``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flipped = flips(half)
        number = np.arange(len(flipped), dtype=np.uint64)
        spread, shift, keep = np.uint64(SPREAD), np.uint64(64 - bucket_bits), np.uint64(bucket_bits)
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(prints), BLOCK):
                spots = (prints[at:at + BLOCK, None] ^ flipped[None, :]) * spread
                buckets = (spots >> shift).astype(np.int32)
                mine = (buckets >= first) & (buckets < last)
                packed = ((spots << keep) | number[None, :])[mine]
                own = buckets[mine] - first
                packed = packed[np.argsort(own, kind="stable")]
                counts = np.bincount(own, minlength=last - first)
                full, ends = np.flatnonzero(counts), np.cumsum(counts)
                offsets = np.concatenate(([0], ends[full])).astype(np.int64) * 8
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(full),
                                                        [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([pa.array((full + first).astype(np.int32)), data.cast(pa.binary())],
                                                 ["bucket", "points"])
    return emit


def meetings(points: np.ndarray, bucket: int, bucket_bits: int, flipped: np.ndarray, radius: int):
    """Links of the fingerprints that meet in a bucket's points: each with the smallest of its group."""
    points = np.sort(points)
    rest = points >> np.uint64(bucket_bits)
    same = rest[1:] == rest[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    if not shared.any():
        return np.zeros((2, 0), np.uint64)
    points, rest = points[shared], rest[shared]
    spots = rest | (np.uint64(bucket) << np.uint64(64 - bucket_bits))
    prints = spots * np.uint64(pow(SPREAD, -1, 1 << 64)) ^ flipped[points & np.uint64((1 << FLIP_BITS) - 1)]
    begins = np.concatenate(([True], rest[1:] != rest[:-1]))
    least = np.minimum.reduceat(prints, np.flatnonzero(begins))[np.cumsum(begins) - 1]
    near = (np.bitwise_count(prints ^ least) <= radius) & (prints != least)
    return np.stack((prints[near], least[near]))


def joined_up(links: np.ndarray) -> np.ndarray:
    """The same components with one link for each number that is not the smallest of its own."""
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(links.shape)
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return np.stack((nodes[moved], nodes[label[moved]]))


def _links(half: int, radius: int, bucket_bits: int, ranges: int):
    """Task code: points in order of buckets to links, packed by ranges of fingerprints."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flipped = flips(half)
        held: list[np.ndarray] = []
        bucket, parts = -1, []

        def close():
            if parts:
                held.append(meetings(np.concatenate(parts), bucket, bucket_bits, flipped, radius))
                parts.clear()
                if sum(x.shape[1] for x in held) > HELD:
                    held[:] = [joined_up(np.concatenate(held, axis=1))]

        def out():
            links = joined_up(np.concatenate(held, axis=1)) if held else np.zeros((2, 0), np.uint64)
            held.clear()
            own = (links[0] * np.uint64(SPREAD) >> np.uint64(40)) % np.uint64(ranges)
            order = np.argsort(own, kind="stable")
            links, own = links[:, order], own[order]
            cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
            packed = [links[:, s:e] for s, e in zip(cuts, [*cuts[1:], len(own)])]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(own[c]) for c in cuts], pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())],
                ["range", "links"])

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != bucket:
                    close()
                    bucket = key
                    if held and held[0].shape[1] > HELD:
                        yield out()
                parts.append(np.frombuffer(data.as_buffer(), np.uint64))
        close()
        yield out()
    return emit


def _distinct_links(table: pa.Table) -> pa.Table:
    links = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(2, -1) for x in table.column("links")], axis=1)
    order = np.lexsort((links[1], links[0]))
    links = links[:, order]
    new = np.concatenate(([True], (links[:, 1:] != links[:, :-1]).any(axis=0)))
    return pa.table({"a": links[0][new].view(np.int64), "b": links[1][new].view(np.int64)})


def near_links(prints: DataFrame, radius: int = 4, passes: int = 4) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``print``, enough to connect all that are near."""
    half = radius // 2 + radius % 2
    if half > 2:
        raise ValueError("the number of flipped bits has room for a radius up to 4")
    n = prints.count()
    balls = sum(1 for k in range(half + 1) for _ in combinations(range(BITS), k))
    # At most some millions of points in a bucket, and no fewer bits than the number of flipped bits takes.
    bucket_bits = max(12, (n * balls >> 21).bit_length())
    ranges = max(64, n >> 16)
    # Blocks of fingerprints for all cores, however little room they take.
    blocks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n >> 14)
    dealt = prints.select("print").repartition(blocks)
    found = None
    for k in range(passes):
        first, last = ((1 << bucket_bits) * x // passes for x in (k, k + 1))
        points = dealt.mapInArrow(_points(half, bucket_bits, first, last), "bucket int, points binary")
        links = (points.repartition("bucket").sortWithinPartitions("bucket")
                 .mapInArrow(_links(half, radius, bucket_bits, ranges), "range int, links binary"))
        links = stored(links)
        found = links if found is None else found.union(links)
    return found.groupBy("range").applyInArrow(_distinct_links, "a long, b long")


def grouped(prints: DataFrame, radius: int = 4, passes: int = 4) -> DataFrame:
    """For ``prints (doc_id, print)`` the ``component_id`` of every distinct ``print``: the smallest id it reaches."""
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    labels = components(near_links(distinct, radius, passes))
    labelled = (distinct.join(labels.select(F.col("node").alias("print"), "label"), "print", "left")
                .withColumn("label", F.coalesce("label", "print")))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.join(smallest, "label").select("print", "label", "component_id")


def mark_near_copies(docs: DataFrame, radius: int = 4, size: int = 4, passes: int = 4) -> DataFrame:
    """``doc_id``, ``print`` and ``component_id`` of every row, with the component's ``label`` and a hash of the text."""
    prints = stored(docs.select("doc_id", fingerprint(F.col("text"), size).alias("print"),
                                F.xxhash64("text").alias("content")))
    return prints.join(grouped(prints, radius, passes), "print")


def drop_near_copies(docs: DataFrame, radius: int = 4, size: int = 4, passes: int = 4) -> DataFrame:
    """One document of each component, that of the smallest id, with its own columns.

    Where several rows have that id, one of them stays.
    """
    first = mark_near_copies(docs, radius, size, passes).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # One row of each component, chosen among ids and hashes, not among texts.
    keepers = (first.groupBy("label", "doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("label").agg(F.min(F.struct("content", "doc_id", "n")).alias("k"))
               .select(F.col("k.doc_id").alias("_near_id"), F.col("k.content").alias("_near_content"),
                       F.col("k.n").alias("_near_rows")))
    rows = docs.withColumn("_near_text", F.xxhash64("text")).join(
        keepers, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_text") == F.col("_near_content")))
    repeated = rows.where("_near_rows > 1").dropDuplicates(["_near_id", "_near_content"])
    return rows.where("_near_rows = 1").unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
