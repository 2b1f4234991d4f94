"""Joins whose large side splits, and running counts along an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def among(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is (``left_anti``: is not) one of the distinct ``ids (key)``.

    A task hashes its share of the ids, one row each, and the rows pass by unsorted, so its memory does not grow with them.
    Rows of one id may still be split by the adaptive planner.
    """
    return df.join(ids.hint("shuffle_hash"), key, how)


def padded(child: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``child`` and a row of nulls for each id of ``ids (key)`` that it does not hold.

    An inner join with it is a left join with ``child``, but one in which the adaptive planner can split
    the rows of a person who has very many; of an outer join it splits only the outer side.
    """
    known = child.select(key).distinct()
    missing = among(ids.select(key).distinct(), known, key, "left_anti")
    return child.where(F.col(key).isNotNull()).unionByName(missing, allowMissingColumns=True)


def chunked(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """Add ``_chunk``: stretches along the order, one for each of ``chunks`` range partitions.

    Written once, so that every pass sees the same stretches. Without ``chunks`` there are as many as
    there are shuffle partitions.
    """
    count = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))


def run_numbers(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Add ``run``: it grows by one where the keys differ from those of the last row that had any.

    Rows that are equal in all columns of ``order`` come in any order, so name enough of them. Each
    stretch of the order is worked through on its own; only one row per stretch, its first and last keys
    and number of changes, is then brought in line.
    """
    has_key = F.coalesce(*keys).isNotNull()
    df = chunked(df, order, chunks).withColumn("_key", F.when(has_key, F.struct(*keys)))
    within = Window.partitionBy("_chunk").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_before", F.last("_key", ignorenulls=True).over(before))
    change = F.col("_key").isNotNull() & F.col("_before").isNotNull() & (F.col("_key") != F.col("_before"))
    opens = F.col("_key").isNotNull() & F.col("_before").isNull()
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_changes": F.sum(change.cast("bigint")).over(upto),
                         "_open": F.max(opens.cast("int")).over(upto)})
    ends = df.groupBy("_chunk").agg(
        F.max("_changes").alias("_inside"),
        F.min_by("_key", F.when(F.col("_key").isNotNull(), F.struct(*order))).alias("_first"),
        F.max_by("_key", F.when(F.col("_key").isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_previous", F.last("_last", ignorenulls=True).over(earlier))
    starts = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_previous"))
    ends = ends.withColumn("_starts", starts.cast("bigint"))
    ends = ends.withColumn("_earlier", F.coalesce(F.sum(F.col("_starts") + F.col("_inside")).over(earlier), F.lit(0)))
    run = F.col("_earlier") + F.col("_changes") + F.col("_open") * F.col("_starts")
    columns = [c for c in df.columns if not c.startswith("_") or c == "_chunk"]
    return df.join(ends.select("_chunk", "_earlier", "_starts"), "_chunk") \
        .select(*[c for c in columns if c != "_chunk"], run.alias("run"))
