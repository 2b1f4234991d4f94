"""Mixing of sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source is one stream of words: its documents in the order of a hash of their ids, cut into
blocks of equally many words. The schedule is a row of slots; slot ``i`` holds the point
``i * golden ratio`` modulo 1, which falls into one source's share of all targets. The slots of a
source are ranked and take its blocks in turn, from the start again after the last, until the target
is reached. Any run of slots therefore holds the sources close to their weights.

Positions in a stream and ranks in the schedule are running sums over one row per chunk plus running
sums within a chunk, so a source that holds most rows is spread over all tasks.

A null text has no words, null is a source of its own and comes last, sources without words get
nothing. Rows that repeat id, source and size share evenly what is taken of them. Empty tables give
empty results; further columns pass through, and input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, word_count

# 2 ** 32 divided by the golden ratio, and the size of the points' grid.
GOLDEN = 2654435769
GRID = 1 << 32

RESULTS = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """For each source its size, weight and target in words, and where its share begins and ends.

    A target is the weight times one level, or ``most`` times the source's size where that is less.
    The level is found along the sources in order of the level at which they are full.
    One row per source goes through the windows here, no documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("full_at", "place")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = (per.withColumn("place", F.row_number().over(by_name) - 1)
           .withColumn("weight", F.element_at(cycle, F.col("place") % len(weights) + 1))
           .withColumn("most", F.col("source_size") * float(most))
           .withColumn("full_at", F.col("most") / F.col("weight"))
           .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                       / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
           .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level")))
                       .over(everything)["level"])
           .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
           .withColumn("high", F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0))))
    total = F.nullif(F.max("high").over(everything), F.lit(0.0))
    return per.select(
        "source", "source_size", "target", total.alias("total"),
        *[F.coalesce(F.floor(F.col(c) / total * GRID), F.lit(0)).cast("long").alias(c) for c in ("low", "high")])


def _running(df: DataFrame, value: Column, chunk: str, order: list[Column]) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over all earlier rows of its source."""
    df = df.withColumn("_value", value)
    chunks = (df.groupBy("source", chunk).agg(F.sum("_value").alias("_sum"))
              .withColumn("_earlier", F.coalesce(F.sum("_sum").over(
                  W.partitionBy("source").orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .select(F.col("source").alias("_source"), F.col(chunk).alias("_chunk"), "_earlier"))
    inside = W.partitionBy("source", chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .join(chunks, F.col("source").eqNullSafe(F.col("_source")) & (F.col(chunk) == F.col("_chunk")))
            .withColumn("before", (F.col("_earlier") + F.col("_inside")).cast("long"))
            .drop("_value", "_source", "_chunk", "_earlier", "_inside"))


def schedule(targets: DataFrame, total: float, block: int, chunk: int = 1 << 16, cells: int = 1024) -> DataFrame:
    """The slots: ``slot``, ``source``, ``before`` (its rank within the source) and ``words`` left to the target.

    A point finds its share through one of ``cells`` equal cells of the unit interval.
    """
    spark = targets.sparkSession
    width = GRID // cells
    shares = (targets.where("high > low")
              .withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}")))))
    slots = (spark.range(-int(-total // block)).select(F.col("id").alias("slot"))
             # The product of two halves stays below 2 ** 63 for any slot number.
             .withColumn("point", F.expr(f"((slot % {GRID}) * {GOLDEN >> 16} % {GRID} * 65536 "
                                         f"+ (slot % {GRID}) * {GOLDEN & 65535}) % {GRID}"))
             .withColumn("cell", F.expr(f"point div {width}"))
             .join(shares, "cell").where("point >= low AND point < high")
             .select("slot", "source", "source_size", "target", F.expr(f"slot div {chunk}").alias("part")))
    ranked = _running(slots, F.lit(1), "part", [F.col("slot")])
    left = F.col("target") - F.col("before") * block
    return ranked.withColumn("words", F.least(F.ceil(left), F.lit(block)).cast("long")).where(left > 0)


def taken_words(sizes: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """Words taken of each ``doc_id``, ``source`` and ``size``; documents of no words are left out."""
    total = targets.agg(F.max("total")).first()[0] or 0.0
    slots = schedule(targets, total, block)
    visits = (slots.withColumn("block", F.expr(f"before % ((source_size + {block - 1}) div {block})"))
              .groupBy(F.col("source").alias("_source"), F.col("block").alias("_block"))
              .agg(F.count(F.lit(1)).alias("visits")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    streams = _running(sizes.where("size > 0").withColumn("key", key).withColumn("part", F.substring("key", 1, 3)),
                       F.col("size"), "part", [F.col("key"), F.col("doc_id"), F.col("size")])
    pieces = (streams.withColumn("block", F.explode(F.sequence(F.expr(f"before div {block}"),
                                                               F.expr(f"(before + size - 1) div {block}"))))
              .withColumn("words", F.expr(f"least(before + size, (block + 1) * {block}) - greatest(before, block * {block})")))
    return (pieces.join(visits, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
            .groupBy("doc_id", "source", "size")
            .agg(F.sum(F.col("words") * F.coalesce("visits", F.lit(0))).alias("_all"),
                 F.count_distinct("before").alias("_rows"))
            .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
                    F.expr("_all div _rows").alias("taken")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 32) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words the mix takes of each.

    ``weights`` go to the sources in order of their names, again and again; no source and no document
    is taken more than ``most`` times; ``block`` words make a block.
    """
    docs = docs.drop(*RESULTS).withColumn("size", word_count(F.col("text")))
    sizes = docs.select("doc_id", "source", "size")
    targets = stored(source_targets(sizes, weights, most))
    taken = taken_words(sizes, targets, block)
    shares = targets.select(F.col("source").alias("_share"), "source_size", "target")
    return (docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
                      & (F.col("size") == F.col("_size")), "left")
            .join(shares, F.col("source").eqNullSafe(F.col("_share")))
            .drop("_id", "_source", "_size", "_share")
            .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 32) -> DataFrame:
    """The mix itself: every document as often as its words are taken, to the nearest whole number.

    A document of which less than half is taken is left out; so is one without words.
    """
    times = F.expr("int(floor(taken / size + 0.5))")
    return (mix(docs, weights, most, block).where("size > 0").withColumn("_times", times).where("_times > 0")
            .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]))
