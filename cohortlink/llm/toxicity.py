"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, their stems (the first letters), pairs of neighbours, and pairs with one
or two words between, each hashed into ``2 ** 20`` places. FTRL-proximal keeps for each place a sum of gradients and of their squares, from
which its weight and its own learning rate follow; an L1 threshold leaves most weights at zero. The weights that
are left, at most one for each place, are broadcast and all texts are scored whole.

It is learned from at most ``MOST_EXAMPLES`` labelled texts, those with the smallest hashes of their ids, passed
``EPOCHS`` times in that order by one task. Rows without a label are not learned from; several labels of one id
count as the greatest; of rows that repeat an id, one is learned from. Null and empty texts have only the constant feature, which no L1 holds at zero: they score the
learned share of toxic texts, below 0.5 unless most examples are toxic. Without examples every score is just below
0.5 and nothing is predicted toxic. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 20
MOST_EXAMPLES = 20_000
EPOCHS = 5
STEM = 6  # letters of a word that stand for its stem
GAPS = (1, 2, 3)  # neighbours, and pairs with one or two words between
STRETCH = 1 << 18  # words hashed at a time
KNOWN_WORDS = 1 << 18
WORD = re.compile(r"[^\W\d_]+")

TOXIC_WEIGHT = 4.0  # toxic texts are the rarer ones
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0


class Words(dict):
    """Hashes of words met before."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


def places(text: str | None, words: Words) -> Iterator[np.ndarray]:
    """Hashed features of stretches of a text."""
    found = WORD.findall((text or "").lower())
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    beginnings = np.fromiter((words[w[:STEM]] for w in found), np.uint64, len(found))
    reach = max(GAPS)
    for at in range(0, len(hashes), STRETCH):
        part = hashes[at:at + STRETCH + reach]
        kinds = [part[:STRETCH] * np.uint64(0x9E3779B97F4A7C15), beginnings[at:at + STRETCH] * np.uint64(0xD6E8FEB86659FD93)]
        for gap in GAPS:
            left, right = part[:-gap][:STRETCH], part[gap:][:STRETCH]
            kinds.append((left * np.uint64(0xC2B2AE3D27D4EB4F) ^ right * np.uint64(0x165667B19E3779F9) + np.uint64(gap))
                         * np.uint64(0x9E3779B97F4A7C15))
        yield (np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_places(text: str | None, words: Words) -> np.ndarray:
    parts = [np.unique(p) for p in places(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last place holds the constant feature."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        # The constant feature is not held to zero: it carries the share of toxic texts.
        l1 = np.where(np.arange(len(self.z))[at] == 1 << BITS, 0.0, L1)
        small = np.abs(z) <= l1
        return np.where(small, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w, n = self.weights(at), self.n[at]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        if label:
            g *= TOXIC_WEIGHT
        if g:
            self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
            self.n[at] = n + g * g


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: labelled texts to their distinct places."""
    words = Words()
    for batch in batches:
        packed = [distinct_places(t.as_py(), words).astype(np.int32).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]],
                                         ["places", *batch.schema.names[1:]])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: a bounded number of examples in order to the weights that are not zero."""
    model = Ftrl()
    examples = [(np.frombuffer(p, np.int32), y) for batch in batches
                for p, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    for _ in range(EPOCHS):
        for at, label in examples:
            model.learn(at, label)
    weights = model.weights(slice(None))
    kept = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], ["place", "weight"])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> dict[int, float]:
    """Weights by place, learned from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``."""
    order = F.xxhash64("doc_id")
    chosen = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("label")).orderBy(order, "doc_id").limit(most))
    # ``most`` ids and labels, some hundred kilobytes.
    examples = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                .select("text", "doc_id", "label", F.xxhash64("text").alias("content"))
                .mapInArrow(_examples, "places binary, doc_id long, label int, content long")
                .groupBy("doc_id", "label").agg(F.min_by("places", "content").alias("places")))
    fitted = (examples.repartition(1).sortWithinPartitions(order, "doc_id").select("places", "label")
              .mapInArrow(_fit, "place long, weight double"))
    return {r.place: r.weight for r in fitted.collect()}


def predict(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """``docs`` with ``score`` between 0 and 1 and ``predicted``."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf(T.DoubleType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros((1 << BITS) + 1)
        table[list(held.value)] = list(held.value.values())
        # Without a learned constant a text without features is just below the line: nothing is toxic without evidence.
        words, constant = Words(), held.value.get(1 << BITS, -1e-9)
        for texts in batches:
            totals = np.full(len(texts), constant)
            for i, text in enumerate(texts):
                # Only places with a weight are made distinct.
                used = [p[table[p] != 0] for p in places(text.as_py(), words)]
                if used:
                    totals[i] += table[np.unique(np.concatenate(used))].sum()
            yield pa.array(1 / (1 + np.exp(-np.clip(totals, -35, 35))))
    return docs.withColumn("score", judge("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    scored = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), weights)
    return scored.where("predicted = 0").select("row.*")
