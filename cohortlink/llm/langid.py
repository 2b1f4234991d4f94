"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else is one blank; all n-grams of 1 to 3 letters are hashed into
``2 ** 16`` features. Counts of all labelled texts are summed in tasks, then by language and range of
features. The logarithms of the smoothed shares make a matrix of fixed width and at most ``MOST_LANGUAGES``
rows, which is broadcast; a text's score is the sum of its features' rows.

Learned from texts with a language; null or letterless texts are ``und`` with score 0, also when nothing
was learned. Equal scores go to the language that comes first by name. Other columns pass through, those named
like a result are replaced. Every row is scored by itself, so repeated rows and ids do not matter; whole texts are used.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 16
RANGE = 1 << 10  # features that travel in one row
MOST_LANGUAGES = 256
UNKNOWN = "und"
# Odd multipliers of the letters of an n-gram, and letters hashed at a time.
SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
STRETCH = 1 << 20


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def features(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Hashed n-grams of a text, as often as they occur; none for a text without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    is_letter = np.concatenate(([False], is_letter, [False]))
    points = np.where(is_letter, np.concatenate(([32], points, [32])), 32).astype(np.uint32)
    points = points[is_letter | np.concatenate(([True], is_letter[:-1]))]
    grams = [points * SPREAD[0]]
    for n in (1, 2):
        grams.append((grams[-1][:-1] ^ (grams[-1][:-1] >> np.uint32(15))) * SPREAD[n] + points[n:] * SPREAD[0])
    return (np.concatenate(grams) >> np.uint32(32 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: texts with languages to counts, a row for each language and range of features."""
    letters, counts, texts = letter_table(), {}, {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
            found = features(text.as_py(), letters)
            for at in range(0, len(found), STRETCH):
                own += np.bincount(found[at:at + STRETCH], minlength=1 << BITS)
            texts[lang] = texts.get(lang, 0) + 1
    yield _rows({(lang, r): own[r * RANGE:(r + 1) * RANGE] for lang, own in counts.items()
                 for r in range((1 << BITS) // RANGE)}, lambda key: texts[key[0]])


def _rows(parts: dict, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in parts], pa.string()), pa.array([k[1] for k in parts], pa.int32()),
        pa.array([texts(k) for k in parts], pa.int64()), pa.array([v.tobytes() for v in parts.values()], pa.binary())],
        ["lang", "part", "texts", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: sums of counts, of which a task holds those of its languages and ranges."""
    sums, texts = {}, {}
    for batch in batches:
        for lang, part, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
            sums[lang, part] = sums.get((lang, part), 0) + np.frombuffer(packed, np.int64)
            texts[lang, part] = texts.get((lang, part), 0) + n
    yield _rows(sums, texts.get)


class Model:
    """Log probabilities by feature and language, and the languages' log shares."""

    def __init__(self, rows: list, smoothing: float = 0.1):
        self.languages = sorted({r.lang for r in rows})
        if len(self.languages) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.languages)} languages are more than the matrix may have: {MOST_LANGUAGES}")
        counts = np.zeros((1 << BITS, len(self.languages)))
        texts = np.zeros(len(self.languages))
        for r in rows:
            at = self.languages.index(r.lang)
            counts[r.part * RANGE:(r.part + 1) * RANGE, at] = np.frombuffer(r.counts, np.int64)
            texts[at] = r.texts
        counts += smoothing
        self.matrix = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        self.shares = np.log(texts / texts.sum()) if len(texts) else texts

    def score(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        found = features(text, letters)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        total = self.shares.copy()
        for at in range(0, len(found), STRETCH):
            total += self.matrix[found[at:at + STRETCH]].sum(axis=0, dtype=np.float64)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum())


def learn(docs: DataFrame, smoothing: float = 0.1) -> Model:
    """The model of ``docs (text, lang)``, all rows whose language is not null."""
    counted = (docs.where("lang IS NOT NULL").select("text", "lang")
               .mapInArrow(_count, "lang string, part int, texts long, counts binary"))
    summed = counted.repartition("lang", "part").mapInArrow(_add, "lang string, part int, texts long, counts binary")
    return Model(summed.collect(), smoothing)


def predict(docs: DataFrame, model: Model, text: Column | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of that language among all."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, of = letter_table(), held.value
        for texts in batches:
            found = [of.score(t.as_py(), letters) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])
    return (docs.withColumn("_judged", judge(F.col("text") if text is None else text))
            .withColumns({"lang_pred": F.col("_judged.lang"), "score": F.col("_judged.score")}).drop("_judged"))
