"""Exact duplicates by progressive refinement, in DataFrame operations only.

Documents are grouped by the length of their normalised text, those that share a length by a hash of
its first letters, and only those that share both by SHA-256 of the whole. Between the steps go keys,
never texts, and all groups are counted before the shuffle, so copies of one text may be any share of
the rows.

Null texts count as empty and empty texts are equal to each other. Of equal texts the smallest id
stays; null ids lose to all others. Rows that repeat an id together with the text are all marked as
kept by :func:`mark_copies`, and :func:`drop_copies` leaves one of them. Rows that repeat an id with
different texts of one length and beginning stay, whatever their copies. Empty tables give empty results.
Further columns pass through; names that begin with ``_exact_`` are reserved, and input columns named
like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_blank, stored

RESULTS = ("keep_id", "group_size", "kept")


def text_sha256(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(one_blank(text).cast("binary"), 256)


def _decided(docs: DataFrame, prefix: int) -> DataFrame:
    norm = one_blank(F.col("text"))
    length, start = F.length(norm), F.xxhash64(F.substring(norm, 1, prefix))
    keyed = docs.drop(*RESULTS).withColumns({"_exact_length": length, "_exact_start": start})

    counted = stored(keyed.groupBy("_exact_length", "_exact_start").agg(F.count(F.lit(1)).alias("n")))
    lengths = counted.groupBy("_exact_length").agg(F.sum("n").alias("rows")).where("rows > 1")
    starts = counted.join(lengths, "_exact_length", "left_semi").where("n > 1")
    # The only step that hashes whole texts: of documents whose length and beginning occur again.
    hashed = stored(keyed.select("doc_id", "text", "_exact_length", "_exact_start")
                    .join(starts, ["_exact_length", "_exact_start"], "left_semi")
                    .select("doc_id", "_exact_length", "_exact_start", text_sha256(F.col("text")).alias("sha")))
    groups = (hashed.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1"))
    decisions = (hashed.join(groups, "sha")
                 .groupBy(F.col("doc_id").alias("_exact_id"), "_exact_length", "_exact_start")
                 .agg(F.min("keep_id").alias("_exact_keep"), F.max("keep_id").alias("_exact_last"),
                      F.max("group_size").alias("_exact_size"), F.when(F.min("sha") == F.max("sha"), 1).otherwise(2).alias("_exact_texts"),
                      F.count(F.lit(1)).alias("_exact_rows")))
    one = F.coalesce(F.col("_exact_texts"), F.lit(1)) == 1
    known = decisions.withColumnsRenamed({"_exact_length": "_exact_l", "_exact_start": "_exact_s"})
    return (keyed.join(known, F.col("doc_id").eqNullSafe(F.col("_exact_id"))
                       & (F.col("_exact_length") == F.col("_exact_l"))
                       & (F.col("_exact_start") == F.col("_exact_s")), "left")
            .withColumns({
                "keep_id": F.when(one & F.col("_exact_size").isNotNull(), F.col("_exact_keep"))
                .otherwise(F.col("doc_id")),
                "group_size": F.when(one, F.coalesce("_exact_size", F.lit(1))).otherwise(F.lit(1)).cast("long")})
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def mark_copies(docs: DataFrame, prefix: int = 256) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept``; ``prefix`` letters are hashed in the second step."""
    marked = _decided(docs, prefix)
    return marked.drop(*[c for c in marked.columns if c.startswith("_exact_")])


def drop_copies(docs: DataFrame, prefix: int = 256) -> DataFrame:
    """The documents that stay, with their own columns."""
    kept = _decided(docs, prefix).where("kept")
    single = F.coalesce(F.col("_exact_rows"), F.lit(1)) == 1
    # Rows that repeat an id and its text: one of them; there is hardly any, so nothing else is shuffled again.
    repeated = kept.where(~single & (F.col("_exact_texts") == 1)).dropDuplicates(["doc_id", "_exact_length",
                                                                                 "_exact_start"])
    return kept.where(single | (F.col("_exact_texts") > 1)).unionByName(repeated).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
