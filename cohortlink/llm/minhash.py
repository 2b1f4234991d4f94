"""Near duplicates by MinHash: bottom-k sketches from one hash function, verified on whole shingle sets.

A document's set holds its distinct word 2-shingles (words lower-cased in A-Z only; with one word, that
word; with none, nothing). Every word is hashed once with XXH64 (seed 42), a shingle by mixing its words'
hashes through the MurmurHash3 finaliser, and the set is ordered by that one hash. The sketch of a set of
n values keeps its k = n - ceil(0.8 n) + 1 smallest: two sets with
100 |A ∩ B| >= 80 |A ∪ B| share at least ceil(0.8 max(|A|, |B|)) values, so the smallest value they share
lies in both sketches, and an inverted list of sketch values meets every such pair. So k grows with the
set, and no pair is lost; a fixed k would miss pairs of long documents.

The one hash function orders values within classes of rarity: the class of a value is the logarithm of the number
of sets that hold it, rounded up, and rarer classes come first. The prefix argument holds for any fixed order of all
values, so no pair is lost; but a line or passage that many documents share no longer fills their sketches. A value
of a single set can meet nothing, so it takes its place in the sketch and no posting: most texts have enough of them
to leave no posting at all. For the counts, values travel as words of 40 bits (two values that share a word share a
class and a list, which costs a comparison, never a link): each chunk of sets asks the buckets of the word space,
which count what all chunks ask and answer with a byte a value. Nothing of this is broadcast.

A set is named by two 64-bit hashes of its sorted values (XXH64 with seeds 1 and 2); two different sets of
a corpus of 10^10 share both names with odds below 10^-18. Equal sets are collapsed into one node with a
number first, so groups of exact copies cost one sketch, and pairs travel as two numbers.

The postings of one value are first joined in stars: each is paired with one pivot of the list, as central as can be,
so a list costs as many pairs as it has members. What is confirmed is linked, and lists whose members all lie in one
component are done. After ``STARS`` rounds, only postings of different components are paired. So a group of near copies
takes links in proportion to its size. Pairs are kept where sizes and positions still allow the threshold (at their
first shared value the overlap is at most one plus the shorter rest). Two bounds then thin them out, both exact. Each
set has a parity sketch, about as many bits as values, each the parity of the number of its values that end in that
bit's number: where two such sketches differ, so do the sets, hence |A ∩ B| <= (|A| + |B| - differing bits) / 2. And the
union of both bottom-k sketches (the k smallest values in plain hash order) up to the smaller of their largest values
bounds the overlap (shared values below it are counted, above it at most the shorter remainder). Only pairs within both
bounds are intersected on their full sets: of the last pairs, each component's most promising one in rounds, then all
others whose nodes are not connected yet, since only the components are asked for.

The sets are compared as sets of 64-bit hashes: two different shingles of one pair of documents share a
hash with odds below 2^-35 for texts of 20 000 words. Null and wordless texts have empty sets and are
linked with nothing: their component is their own id. A null id is never the smallest unless a component
has no other; its ``kept`` is false. Repeated rows share a node. Empty tables give empty results. Whole
sets are never stored: they are found again from the text, for the candidate pairs only. The input's
columns are carried in one struct, so no name of theirs clashes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

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

SEED = 42
# Link at 100 * |A ∩ B| >= LEAST * |A ∪ B|.
LEAST = 80
RESULT = ("n_shingles", "component_id", "kept")
# Candidate sets fetched by a broadcast of their names up to so many, by a shuffle beyond.
BROADCAST_NAMES = 1 << 21
WORD_BYTES = 5  # of a value's hash, for counts and postings
CHUNK_BITS = 10  # so many sets ask for their counts together, as a power of two
BUCKET = 1 << 20  # values counted at a time, about
STARS = 1  # rounds of pairs with a pivot of each list, before pairs across components
ROUNDS = 1  # of checks of each component's most promising pair, before all pairs left

MIX1, MIX2, ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _finish(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_values(text: bytes | None, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes (as signed numbers) of the 2-word shingles of UTF-8 ``text``.

    Words are runs of bytes other than space and 0x09-0x0D, lower-cased in A-Z; one word is its own shingle.
    Each word is hashed once with XXH64 (seed 42); a shingle's hash mixes its two words' hashes.
    """
    words = (text or b"").lower().split()
    known = {} if known is None else known
    hashes = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w, SEED)) for w in words),
                         np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(words) < 2:
            grams = _finish(hashes ^ ONE)
        else:
            grams = _finish(_finish(hashes[:-1] * MIX1) + hashes[1:] * MIX2)
    if len(known) > 1 << 18:
        known.clear()
    return np.unique(grams.view(np.int64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _length(n: int) -> int:
    return n - (n * LEAST + 99) // 100 + 1 if n else 0


def _packed(values: np.ndarray) -> bytes:
    """The leading bits of the values, as little-endian words of ``WORD_BYTES``."""
    words = values.view(np.uint64) >> np.uint64(64 - 8 * WORD_BYTES)
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()


def _unpacked(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, WORD_BYTES)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :WORD_BYTES] = raw
    return full.view("<u8").ravel()


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """64-bit words, a power of two of them and at least a bit a value; a bit is the parity of the values that end in its number."""
    bits = max(256, 1 << max(len(values) - 1, 0).bit_length())
    odd = np.bincount(values & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


SUMMARY = T.StructType([T.StructField("_k1", T.LongType()), T.StructField("_k2", T.LongType()), T.StructField("n_shingles", T.LongType()),
                        T.StructField("words", T.BinaryType())])


def _names_of(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return _signed(xxhash.xxh64_intdigest(raw, 1)), _signed(xxhash.xxh64_intdigest(raw, 2))


def summaries(with_words: bool):
    """A pandas UDF: per text its set's two names (XXH64 of the sorted values, seeds 1 and 2), size and, if asked for, packed words."""
    @F.pandas_udf(SUMMARY)
    def summary(texts: pd.Series) -> pd.DataFrame:
        known: dict = {}
        sets = (shingle_values(None if t is None else t.encode(), known) for t in texts)
        return pd.DataFrame([(*_names_of(s), len(s), _packed(s) if with_words else None) for s in sets],
                            columns=["_k1", "_k2", "n_shingles", "words"])
    return summary.asNondeterministic()  # so that a filter on the result does not make it again


NAMED = T.StructType([T.StructField("_k1", T.LongType()), T.StructField("_k2", T.LongType()), T.StructField("n_shingles", T.LongType()),
                      T.StructField("_set", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))])


@F.pandas_udf(NAMED)
def shingle_set(texts: pd.Series) -> pd.DataFrame:
    """Per text its set's two names, size, values and parity sketch."""
    known: dict = {}
    sets = [shingle_values(None if t is None else t.encode(), known) for t in texts]
    return pd.DataFrame([(*_names_of(s), len(s), s, parity_sketch(s)) for s in sets],
                        columns=["_k1", "_k2", "n_shingles", "_set", "parity"])


shingle_set = shingle_set.asNondeterministic()


def sketch_length(n: Column) -> Column:
    """How many of the smallest values a set of ``n`` keeps: n - ceil(LEAST n / 100) + 1 (none when empty)."""
    return F.when(n > 0, n - F.floor((n * LEAST + 99) / 100).cast("long") + 1).otherwise(0)


def _reaches(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """``overlap`` meets the threshold: 100 I >= LEAST (|A| + |B| - I)."""
    return overlap * (100 + LEAST) >= (n_a + n_b) * LEAST


def named_sets(docs: DataFrame, with_words: bool = False) -> DataFrame:
    """``docs`` with the names ``_k1``, ``_k2`` of its set, ``n_shingles`` and, if asked for, ``words``."""
    named = docs.withColumn("_summary", summaries(with_words)(F.col("text"))).select("*", "_summary.*").drop("_summary")
    return named if with_words else named.drop("words")


def _buckets_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words * np.uint64(buckets)) >> np.uint64(8 * WORD_BYTES)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _asking(buckets: int):
    """Task code: sets ``(id, words)`` to what each run of sets of a chunk asks each bucket of the word space."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            chunks = ids >> CHUNK_BITS
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                words = _unpacked(batch.column(1).slice(i, j - i).to_pylist())
                own = _buckets_of(words, buckets)
                asked = words[np.argsort(own, kind="stable")].astype("<u4")
                full, counts = np.unique(own, return_counts=True)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), chunks[i])), pa.array(np.full(len(full), ids[i])), pa.array(full.astype(np.int32)),
                     pa.array([asked[e - c:e].tobytes() for c, e in zip(counts, ends)], pa.binary())], ["chunk", "start", "bucket", "asked"])
    return ask


def _classes(asked: pa.Table) -> pa.Table:
    """Task code: what is asked of a bucket to the class of each value, the logarithm of its count, rounded up."""
    parts = asked["asked"].to_pylist()
    _, at, counts = np.unique(np.frombuffer(b"".join(parts), "<u4"), return_inverse=True, return_counts=True)
    classes = np.frexp(counts - 1)[1].astype(np.uint8)[at]
    ends = np.cumsum([len(p) // 4 for p in parts])
    answers = [classes[e - len(p) // 4:e].tobytes() for p, e in zip(parts, ends)]
    return pa.table([asked["chunk"], asked["start"], asked["bucket"], pa.array(answers, pa.binary())],
                    names=["chunk", "start", "bucket", "classes"])


POSTINGS = ("value", "id", "n", "pos")


def _posting(buckets: int):
    """Task code: a chunk's sets ``(id, n, words)`` and the answers to it, to the postings of their sketches."""
    def post(sets: pa.Table, answers: pa.Table) -> pa.Table:
        sets, answers = sets.sort_by("id"), answers.sort_by([("start", "ascending"), ("bucket", "ascending")])
        ids, sizes = sets["id"].to_numpy(), sets["n"].to_numpy()
        starts, classes = answers["start"].to_numpy(), answers["classes"].to_pylist()
        words = sets["words"].to_pylist()
        firsts, out = np.unique(starts), []
        for first, last in zip(firsts, [*firsts[1:], None]):
            i, j = np.searchsorted(ids, first), len(ids) if last is None else np.searchsorted(ids, last)
            values, n = _unpacked(words[i:j]), sizes[i:j]
            rarity = np.empty(len(values), np.uint8)
            order = np.argsort(_buckets_of(values, buckets), kind="stable")
            mine = slice(np.searchsorted(starts, first), np.searchsorted(starts, first, side="right"))
            rarity[order] = np.frombuffer(b"".join(classes[mine]), np.uint8)
            row = np.repeat(np.arange(j - i), n)
            order = np.lexsort((values, rarity, row))
            row, pos = row[order], np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            keep = (pos < (n - (n * LEAST + 99) // 100 + 1)[row]) & (rarity[order] > 0)
            row, order = row[keep], order[keep]
            out.append((values[order].astype(np.int64), ids[i:j][row], n[row], pos[keep]))
        return pa.table([pa.array(np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for c in range(4)], names=POSTINGS)
    return post


def _postings(sketched: DataFrame) -> DataFrame:
    """The postings ``value, id, n, pos`` of the sketches of ``sketched (id, n, words)``, without values that no two sets share."""
    total = sketched.agg(F.sum("n")).first()[0] or 0
    buckets = total // BUCKET + 1
    asked = sketched.select("id", "words").mapInArrow(_asking(buckets), "chunk long, start long, bucket int, asked binary")
    answers = stored(asked.groupBy("bucket").applyInArrow(_classes, "chunk long, start long, bucket int, classes binary"))
    chunks = sketched.select(F.shiftright("id", CHUNK_BITS).alias("chunk"), "id", "n", "words")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_posting(buckets), "value long, id long, n long, pos long")


def _folded(long: Column, short: Column) -> Column:
    """A parity sketch brought to the size of one that is half as long."""
    half = F.size(short)
    return F.when(F.size(long) > half, F.zip_with(F.slice(long, 1, half), F.slice(long, half + 1, half), lambda x, y: x.bitwiseXOR(y))) \
        .otherwise(long)


def _may_reach(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Sizes, and positions of a first shared value, allow the threshold."""
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * LEAST) & _reaches(F.least(n_a - pos_a, n_b - pos_b), n_a, n_b)


def _within_bounds(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``met (a, b)`` of ``sets (id, n, parity, set)`` that are within the bounds, and the likeness ``most`` they allow."""
    parities = sets.select("id", "n", "parity")
    both = met.join(parities.toDF("a", "n_a", "p_a"), "a").join(parities.toDF("b", "n_b", "p_b"), "b")
    # Sizes within the threshold have sketches of one size, or one of half the other's.
    apart = F.aggregate(F.zip_with(_folded(F.col("p_a"), F.col("p_b")), _folded(F.col("p_b"), F.col("p_a")), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda total, x: total + x)
    by_parity = F.floor((F.col("n_a") + F.col("n_b") - apart) / 2)
    met = stored(both.withColumn("by_parity", by_parity).where(_reaches(F.col("by_parity"), F.col("n_a"), F.col("n_b")))
                 .select("a", "b", "n_a", "n_b", "by_parity"))
    # Shared values up to the smaller of the largest values of both sketches are known exactly, above it at most the shorter remainder.
    sketches = sets.select("id", F.slice("set", F.lit(1), sketch_length(F.col("n")).cast("int")).alias("sk")).select("id", "sk", F.element_at("sk", -1).alias("end"))
    both = met.join(sketches.toDF("a", "sk_a", "end_a"), "a").join(sketches.toDF("b", "sk_b", "end_b"), "b") \
        .withColumn("top", F.least("end_a", "end_b"))

    def low(sketch: str) -> Column:
        return F.size(F.filter(sketch, lambda v: v <= F.col("top")))
    by_union = F.size(F.array_intersect("sk_a", "sk_b")) + F.least(F.col("n_a") - low("sk_a"), F.col("n_b") - low("sk_b"))
    return stored(both.withColumn("bound", F.least(by_union, F.col("by_parity"))).where(_reaches(F.col("bound"), F.col("n_a"), F.col("n_b")))
                  .select("a", "b", (F.col("bound") / (F.col("n_a") + F.col("n_b") - F.col("bound"))).alias("most")))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets meet the threshold."""
    sides = pairs.select("a", "b").join(sets.toDF("a", "n_a", "set_a"), "a").join(sets.toDF("b", "n_b", "set_b"), "b")
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    return stored(sides.where(_reaches(overlap, F.col("n_a"), F.col("n_b"))).select("a", "b"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (id, label)`` after the components that ``links (a, b)`` connect are one."""
    ends = links.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    moved = stored(components(ends)).toDF("label", "_to")
    return stored(labels.join(moved, "label", "left").select("id", F.coalesce("_to", "label").alias("label")))


def _linked(pairs: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels (id, label)`` after the confirmed ones of ``pairs (a, b, most)``, which lie across components.

    In each round the most promising pair of every component is checked, and pairs within a component are dropped, so a group
    of near copies takes links in proportion to its size; after ``ROUNDS``, all pairs left are checked.
    """
    rest = pairs.select("a", "b", "most")
    for _ in range(ROUNDS):
        named = stored(rest.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b").where("label_a <> label_b"))
        sides = named.select(F.col("label_a").alias("id"), "most", "a", "b").union(named.select(F.col("label_b").alias("id"), "most", "a", "b"))
        best = stored(sides.groupBy("id").agg(F.max(F.struct("most", "a", "b")).alias("_best")).select("_best.a", "_best.b").distinct())
        if best.isEmpty():
            return labels
        labels = _merged(labels, _confirmed(best, sets))
        rest = named.select("a", "b", "most").join(best, ["a", "b"], "left_anti")
    rest = rest.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b").where("label_a <> label_b")
    return _merged(labels, _confirmed(rest, sets))


def _open_lists(postings: DataFrame, labels: DataFrame, first: Column) -> DataFrame:
    """Postings with labels and the pivot of their list, the smallest by ``first``; lists within one component are left out."""
    named = postings.join(labels, "id")
    lists = named.groupBy("value").agg(F.min(F.struct(first.alias("first"), "id", "n", "pos", "label")).alias("pivot"),
                                       F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high")
    return named.join(lists.select("value", "pivot"), "value")


def _labels(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """``id`` and ``label``, its component, of the nodes of ``postings (value, id, n, pos)``, with their ``sets (id, n, parity, set)``."""
    labels, tried = sets.select("id", F.col("id").alias("label")), None
    whole = sets.select("id", "n", "set")
    for turn in range(STARS):
        # A posting far in front belongs to a set with few values of its own, so it is most like the others; among such, another each time.
        first = F.struct(F.floor(F.col("pos") * 32 / F.col("n")), F.xxhash64("id", F.lit(turn)))
        named = stored(_open_lists(postings, labels, first))
        star = named.where((F.col("label") != F.col("pivot.label")) & _may_reach(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"))) \
            .select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()
        met = stored(star if tried is None else star.join(tried, ["a", "b"], "left_anti"))
        tried = met if tried is None else tried.unionByName(met)
        if met.isEmpty():
            break
        labels = _merged(labels, _confirmed(_within_bounds(met, sets), whole))
        postings = named.select(*POSTINGS)
    across = stored(_open_lists(postings, labels, F.lit(0)).select(*POSTINGS, "label"))
    a, b = across.alias("a"), across.alias("b")
    met = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.label") != F.col("b.label"))
                 & _may_reach(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")))
    met = stored(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    return _linked(_within_bounds(met, sets), whole, labels)


def near_labels(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, ``n_shingles``, ``_k1``, ``_k2`` and ``label``.

    ``label`` names the row's component (null for an empty set).
    """
    slim = docs.select("doc_id", "text")
    base = stored(named_sets(slim).select("doc_id", "_k1", "_k2", "n_shingles"))
    ordered = named_sets(slim, with_words=True).where("n_shingles > 0") \
        .withColumn("_text", F.xxhash64("text")).dropDuplicates(["_k1", "_k2"])
    sketched = stored(ordered.select(F.monotonically_increasing_id().alias("id"), "_k1", "_k2", "_text", F.col("n_shingles").alias("n"), "words"))
    postings = stored(_postings(sketched))
    postings = stored(postings.join(postings.groupBy("value").count().where("count > 1").select("value"), "value"))
    nodes = stored(sketched.select("id", "_k1", "_k2", "_text"))
    wanted = stored(nodes.join(postings.select("id").distinct(), "id"))
    texts = wanted.select("_text").distinct()
    if wanted.count() <= BROADCAST_NAMES:
        texts = F.broadcast(texts)
    # Whole sets are made again from the texts of the candidates only, found by a hash of the text.
    chosen = slim.select("text", F.xxhash64("text").alias("_text")).join(texts, "_text", "left_semi").dropDuplicates(["text"])
    made = chosen.select(shingle_set(F.col("text")).alias("_made")).select("_made.*")
    sets = stored(made.join(wanted, ["_k1", "_k2"]).select("id", F.col("n_shingles").alias("n"), "parity", F.col("_set").alias("set")).dropDuplicates(["id"]))
    labels = _labels(postings, sets)
    # A set that is linked with nothing is its own component.
    named = nodes.join(labels, "id", "left").select("_k1", "_k2", F.coalesce("label", "id").alias("label"))
    return base.join(named, ["_k1", "_k2"], "left")


def _with_components(labelled: DataFrame) -> DataFrame:
    smallest = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    marked = labelled.join(smallest, "label", "left")
    return marked.withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: doc_id, ``n_shingles``, ``component_id`` and ``kept``; see ``mark_near_copies``."""
    marked = _with_components(near_labels(docs))
    return marked.select("doc_id", "n_shingles", "component_id",
                         F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def mark_near_copies(docs: DataFrame) -> DataFrame:
    """Every row of ``docs (doc_id, text, ...)`` with ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest doc_id reachable by links, the row's own included; ``kept`` is
    ``doc_id = component_id`` (false for a null id). The input's columns come back under their names, but
    for those named like a result, which are replaced. The rows are matched to their components by the
    names of their sets, found again from the text.
    """
    named = stored(_with_components(near_labels(docs)).where("label IS NOT NULL")
                   .select("_k1", "_k2", "component_id").dropDuplicates(["_k1", "_k2"]))
    rows = named_sets(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                                  F.col("doc_id"), F.col("text")))
    marked = rows.join(named, ["_k1", "_k2"], "left").withColumn("label", F.when(F.col("n_shingles") > 0, F.lit(1)))
    carried = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in RESULT]
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.select(*carried, "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest id; the columns of ``docs``."""
    return mark_near_copies(docs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
