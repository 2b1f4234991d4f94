"""Ranked lexical search: each query's best documents by integer BM25-like impacts, pruned over norm buckets.

Terms are the maximal runs of characters that are not ASCII punctuation, blanks or controls, with A-Z
lower-cased. Over all documents: N counts those with a term, L all their terms; per document n counts its
terms and m = 50 + (50 n N) div L; per term df counts the documents holding it. A query term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's impact for a term it holds tf times is
(10^9 tf) div (1000 tf + 20 m). A score sums w * impact over the query's distinct terms; all but w and
the logarithm are 64-bit integers.

The search follows LEMP: documents are held as impact vectors over the queries' terms and sorted into
buckets of like norm (a factor of e^(1/64) apart). For a query and a bucket two upper bounds hold: its
norm times the bucket's largest (Cauchy-Schwarz), and the sum of w times the bucket's largest impact of
each term (coordinates). Each query first scores the buckets of its highest bounds until they are
sure to hold ``k`` documents of positive score; the k-th of these scores is a floor that the final k-th
cannot fall below. Only buckets whose bound reaches that floor are scored, and inside them only
documents whose own norm bound reaches it. Impact vectors are dealt to tasks whole, by row, and a pair's
score is added up where its row is, so pairs of a query and a document are never shuffled before they are known
to score the floor at least. Survivors' scores are exact and the best k are taken, equal scores by ascending
doc_id (nulls last), then by row.

Every row of ``docs`` is a document: repeated rows count and rank apart, null texts have no terms,
documents without a term of the query never score. Queries with null or termless text find nothing.
Empty tables give empty results. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the contract: the pattern of a term and the constants of the weights.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 50
STEPS = 64  # norm buckets per factor e
BROADCAST_TERMS = 1 << 20  # the queries' terms are broadcast up to so many, joined by a shuffle beyond
SPREAD = 64  # parts of a query's candidates ranked apart before the final rank


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def _best(scored: DataFrame, k: int, part: Column) -> DataFrame:
    """The ``k`` best rows of each item, in two steps so that no task holds all candidates of an item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    first = scored.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", part).orderBy(*order))).where(f"_n <= {k}")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(f"rank <= {k}").drop("_n")


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each row of ``queries (item_id, text)`` the ``k`` best rows of ``docs (doc_id, text)`` with score above 0.

    Returns item_id, rank (int, from 1), doc_id, score (long).
    """
    rows = docs.select("doc_id", terms_of(F.col("text")).alias("terms")).withColumn("row", F.monotonically_increasing_id())
    asked = queries.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct()
    vocabulary = asked.select("term").distinct().withColumn("_asked", F.lit(True))
    if vocabulary.count() <= BROADCAST_TERMS:
        vocabulary = F.broadcast(vocabulary)
    # One pass over the texts counts the queries' terms of every row; the row's first term stands for the row.
    found = rows.select("row", "doc_id", F.size("terms").cast("long").alias("n"), F.posexplode_outer("terms").alias("pos", "term"))
    kept = found.join(vocabulary, "term", "left").where("_asked OR pos IS NULL OR pos = 0")
    tf = stored(kept.groupBy("row", "doc_id", "n", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("_asked").alias("_asked"), F.min(F.coalesce("pos", F.lit(0))).alias("pos")))
    total = tf.where("pos = 0").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = int(total["N"]), int(total["L"])
    m = F.expr(f"50 + (n * {50 * n_docs}) div {max(n_terms, 1)}")
    impacts = tf.where("_asked").withColumn("m", m).select(
        "row", "doc_id", "term", F.expr("(1000000000 * tf) div (1000 * tf + 20 * m)").alias("impact"))
    df = impacts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "term").select(
        "item_id", "term", F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2)) / (F.col("df") * 2 + 1))).cast("long").alias("w"))
    weights = stored(weights)
    norms = impacts.groupBy("row").agg(F.sqrt(F.sum(F.col("impact").cast("double") ** 2)).alias("norm"))
    postings = stored(impacts.join(norms, "row").withColumn("bucket", F.floor(F.log("norm") * STEPS).cast("int")))
    tops = postings.groupBy("bucket", "term").agg(F.max("impact").alias("top"), F.count(F.lit(1)).alias("docs"))
    largest = postings.groupBy("bucket").agg(F.max("norm").alias("largest"))
    q_norm = weights.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w").cast("double") ** 2)).alias("q_norm"))
    bounds = weights.join(tops, "term").groupBy("item_id", "bucket").agg(
        F.sum(F.col("w") * F.col("top")).alias("coordinates"), F.max(F.when(F.col("w") > 0, F.col("docs")).otherwise(0)).alias("sure"))
    bounds = bounds.join(largest, "bucket").join(q_norm, "item_id").select(
        "item_id", "bucket", "sure",
        F.least(F.col("coordinates").cast("double"), F.col("q_norm") * F.col("largest") * (1 + 1e-9) + 1).alias("bound"))
    bounds = stored(bounds)
    before = Window.partitionBy("item_id").orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = bounds.withColumn("_sure", F.coalesce(F.sum("sure").over(before), F.lit(0))).where(f"_sure < {k}")

    few = weights.count() <= BROADCAST_TERMS and bounds.count() <= BROADCAST_TERMS

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    def scored(chosen: DataFrame, floor: DataFrame | None) -> DataFrame:
        pairs = postings.repartition("row").join(small(weights), "term").join(small(chosen.select("item_id", "bucket")), ["item_id", "bucket"])
        if floor is not None:
            least = q_norm.join(floor, "item_id", "left")
            pairs = pairs.join(small(least), "item_id").where(
                F.col("floor").isNull() | (F.col("norm") * F.col("q_norm") * (1 + 1e-9) + 1 >= F.col("floor")))
        # Grouped by row before all else, so that the sums need no shuffle.
        sums = pairs.groupBy("row", "item_id", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")
        if floor is None:
            return sums
        return sums.join(small(floor), "item_id", "left").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))) \
            .select("row", "item_id", "doc_id", "score")

    early = stored(_best(scored(first, None), k, F.pmod(F.col("row"), F.lit(SPREAD))))
    floors = early.where(f"rank = {k}").select("item_id", F.col("score").alias("floor"))
    rest = stored(bounds.join(first.select("item_id", "bucket"), ["item_id", "bucket"], "left_anti").join(floors, "item_id", "left")
                  .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("item_id", "bucket"))
    late = scored(rest, floors).select("item_id", "row", "doc_id", "score")
    best = _best(stored(early.select("item_id", "row", "doc_id", "score").unionByName(late)), k, F.pmod(F.col("row"), F.lit(SPREAD)))
    return best.select("item_id", F.col("rank").cast("int"), F.col("doc_id").cast("long"), F.col("score").cast("long"))


def plain_weight(n_docs: int, df: int) -> int:
    """The weight of a term in Python, for tests."""
    return math.floor(1000.0 * math.log((2.0 * n_docs + 2) / (2 * df + 1)))
