"""Vector code compression: a product codebook learned in integer rounds, parts assigned through a trie.

Rows whose vector is null, holds a null or a non-finite component, or differs in length from the vector of
the smallest kept vec_id are dropped. Each component x becomes floor(1024 x); a vector of d components is
cut into 4 consecutive parts at floor(i d / 4) (equal parts when 4 divides d). Each part position has a
codebook that starts as that part of the (up to) 256 kept rows of smallest vec_id (nulls last, then by
vector). Each of ``ROUNDS`` rounds assigns every part to its codebook's nearest entry (squared Euclidean
distance, ties to the lower index) and replaces each used entry by the componentwise floor of the mean of
its parts; unused entries stay. Finally parts are assigned again.

Assignment works on distinct parts with their counts, so copies cost nothing. Within a task the distinct
parts of a position are sorted lexicographically and read as a trie: a node's vector of distances to all
entries is its parent's plus the distance in its own component, so parts that share a prefix share its
work; leaves take the argmin and add count times the part to their entry's sums. Tasks send partial sums
per entry, which are added up by entry; the codebooks (4 x 256 entries) are the only thing on the driver.

Empty tables give empty results; null vec_ids and labels are carried (labels are summed with nulls as
one label); repeated rows are coded alike. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CHUNK = 2048  # distinct parts whose trie is walked at a time


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row of ``parts`` (sorted lexicographically) via their trie."""
    m, width = parts.shape
    entries = np.zeros(m, np.int64)
    distances = np.zeros(m, np.int64)
    if m == 0:
        return entries, distances
    for lo in range(0, m, CHUNK):
        chunk = parts[lo:lo + CHUNK]
        n = len(chunk)
        # Depth at which each row leaves the path of the row before it (0 for the first of the chunk).
        same = np.ones((n, width + 1), bool)
        if width:
            same[1:, 1:] = np.cumprod(chunk[1:] == chunk[:-1], axis=1).astype(bool)
        same[0, 1:] = False
        acc = np.zeros((1, len(book)), np.int64)
        starts = np.array([0])
        for depth in range(width):
            new = np.flatnonzero(~same[:, depth + 1])  # rows that open a node at this depth
            parent = np.searchsorted(starts, new, side="right") - 1
            step = (book[:, depth][None, :] - chunk[new, depth][:, None]) ** 2
            acc, starts = acc[parent] + step, new
        leaf = np.searchsorted(starts, np.arange(n), side="right") - 1
        totals = acc[leaf]
        entries[lo:lo + n] = totals.argmin(axis=1)
        distances[lo:lo + n] = totals[np.arange(n), entries[lo:lo + n]]
    return entries, distances


def _parts_of(ints: Column, width: int) -> Column:
    bounds = [i * width // PARTS for i in range(PARTS + 1)]
    return F.array(*[F.slice(ints, bounds[i] + 1, bounds[i + 1] - bounds[i]) for i in range(PARTS)])


def _walk(books: list[np.ndarray], emit_sums: bool):
    """A mapInPandas function over sorted distinct parts (p, part, count)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for p, group in frame.groupby("p", sort=False):
                book = books[p]
                width = book.shape[1]
                parts = np.array(group["part"].tolist(), np.int64).reshape(len(group), width)
                entries, distances = nearest(parts, book)
                if emit_sums:
                    counts = group["count"].to_numpy(np.int64)
                    sums = np.zeros_like(book)
                    np.add.at(sums, entries, parts * counts[:, None])
                    used = np.bincount(entries, weights=None, minlength=len(book)) > 0
                    tally = np.zeros(len(book), np.int64)
                    np.add.at(tally, entries, counts)
                    rows = np.flatnonzero(used)
                    yield pd.DataFrame({"p": p, "entry": rows, "count": tally[rows], "sum": [sums[r].tolist() for r in rows]})
                else:
                    yield pd.DataFrame({"p": p, "part": group["part"].tolist(), "entry": entries, "distance": distances})
    return run


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``vectors (vec_id, embedding, label)`` with code, error, label_error and codebooks_sha256."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & finite).select(
        "vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("ints"))
    smallest = [F.col("vec_id").asc_nulls_last(), "ints"]
    first = kept.orderBy(*smallest).limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = len(first[0]["ints"])
    kept = kept.where(F.size("ints") == width)
    first = kept.orderBy(*smallest).limit(ENTRIES).collect()
    bounds = [i * width // PARTS for i in range(PARTS + 1)]
    books = [np.array([r["ints"][bounds[p]:bounds[p + 1]] for r in first], np.int64).reshape(len(first), bounds[p + 1] - bounds[p])
             for p in range(PARTS)]
    rows = stored(kept.withColumn("row", F.monotonically_increasing_id()))
    exploded = rows.select("row", F.posexplode(_parts_of(F.col("ints"), width)).alias("p", "part"))
    distinct = stored(exploded.groupBy("p", "part").agg(F.count(F.lit(1)).alias("count")).sortWithinPartitions("p", "part"))
    sums_schema = "p int, entry long, count long, sum array<long>"
    for _ in range(rounds):
        partial = distinct.mapInPandas(_walk(books, True), sums_schema)
        totals = partial.select("p", "entry", "count", F.posexplode("sum").alias("j", "s")) \
            .groupBy("p", "entry", "j").agg(F.sum("count").alias("count"), F.sum("s").alias("s")).collect()
        books = _renewed(books, totals)
    assigned = distinct.mapInPandas(_walk(books, False), "p int, part array<long>, entry long, distance long")
    coded = exploded.join(assigned, ["p", "part"]).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("p", "entry"))).alias("codes"), F.sum("distance").alias("error"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c["entry"])), 2, "0")))
    out = rows.select("row", "vec_id", "label").join(coded, "row").select("vec_id", "label", code.alias("code"), F.col("error").cast("long"))
    per_label = out.groupBy("label").agg(F.sum("error").cast("long").alias("label_error"))
    out = out.join(per_label, out["label"].eqNullSafe(per_label["label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
    return out


def _renewed(books: list[np.ndarray], totals: list) -> list[np.ndarray]:
    """Used entries become the floor of their parts' mean; the others stay."""
    fresh = [b.copy() for b in books]
    for r in totals:
        fresh[r["p"]][r["entry"], r["j"]] = r["s"] // r["count"]
    return fresh


def codebooks_sha256(books: list[np.ndarray]) -> str:
    text = ",".join(str(int(v)) for book in books for entry in book for v in entry)
    return hashlib.sha256(text.encode()).hexdigest()
