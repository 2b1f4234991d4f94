"""What the text operators share: words, samples by checksum, and tables between two steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# The white space between words, as a class of a regular expression and as characters to trim.
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(doc_id: Column, parts: int) -> Column:
    """CRC-32 of an id's text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def one_blank(text: Column) -> Column:
    """Text with each run of blanks as one space; null is empty.

    Lone spaces, by far the most runs, are left alone by the pattern.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{BLANKS}]{{2,}}|[\x09-\x0D]", " ")


def word_count(text: Column) -> Column:
    """Number of words; each becomes one letter, whose number is the length."""
    inner = F.rtrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARACTERS))
    return F.length(F.regexp_replace(inner, rf"[{BLANKS}]*[^{BLANKS}]+", "x")).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """``df`` read back from a checkpoint in the shared folder of the session.

    What its shuffles left on the executors' disks goes when it is written.
    """
    conf = df.sparkSession.conf
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting)
    conf.set(setting, "true")
    try:
        return cut_lineage(df.select("*"))  # the setting holds for tables defined after it
    finally:
        conf.set(setting, before)
