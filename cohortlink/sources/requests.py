"""Request lists: ids or demographics in CSV files, or in columns of any DataFrame."""

from __future__ import annotations

from itertools import chain

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_dob, parse_id, strip
from ..session import cut_lineage


def _read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool) -> DataFrame | None:
    """CSV with a header, every column text; None when the file or a named column is missing."""
    try:
        df = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line,
                            encoding="UTF-8", mode="PERMISSIVE")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise
    return df if set(columns) <= set(df.columns) else None


def number_rows(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Number the rows of a file-based DataFrame from 1, in file order.

    Rows are written once to the checkpoint folder with their file, block and place, so numbers
    stay the same if tasks run again. Only one count per block is brought in order.
    """
    placed = cut_lineage(df.select("*", F.col("_metadata.file_path").alias("_file"),
                                   F.col("_metadata.file_block_start").alias("_block"),
                                   F.monotonically_increasing_id().alias("_place")))
    blocks = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(blocks, ["_file", "_block"]) \
        .withColumn(name, F.col("_before") + F.col("_place") - F.col("_first") + 1) \
        .select(name, *df.columns)


def _numbered(df: DataFrame, row_column: str | None) -> DataFrame:
    if row_column is None:
        return number_rows(df)
    return df.select(F.col(row_column).cast("bigint").alias("row_number"), *[c for c in df.columns if c != row_column])


def id_requests(df: DataFrame, id_column: str = "PatientID", row_column: str = "row_number") -> DataFrame:
    """Id requests of a DataFrame: blank ids dropped, order and duplicates kept, id null when no number."""
    raw = strip(F.col(id_column).cast("string"))
    return df.select(F.col(row_column).cast("bigint").alias("row_number"), raw.alias("raw_id"),
                     parse_id(F.col(id_column).cast("string")).alias("id")) \
        .where(F.length("raw_id") > 0)


def read_id_requests(spark: SparkSession, path: str, id_column: str = "PatientID",
                     row_column: str | None = None, multi_line: bool = True) -> DataFrame:
    """Id requests of a CSV file; no rows when the file or its id column is missing.

    Fields may hold line ends; for files without any, ``multi_line=False`` reads one file in several tasks.
    """
    df = _read_csv(spark, path, [id_column], multi_line)
    if df is None:
        return spark.createDataFrame([], "row_number bigint, raw_id string, id bigint")
    return id_requests(_numbered(df, row_column), id_column)


def raw_map(columns: list[str]) -> Column:
    """The row as a map from column name to text."""
    return F.create_map(*chain.from_iterable((F.lit(c), F.col(f"`{c}`").cast("string")) for c in columns))


def demographic_requests(df: DataFrame, first_name: str = "FirstName", last_name: str = "LastName",
                         dob: str = "DOB", row_column: str = "row_number") -> DataFrame:
    """Demographic requests of a DataFrame: names trimmed, birth date parsed, the row kept as a map."""
    def text(c):
        return F.coalesce(strip(F.col(c).cast("string")), F.lit(""))
    raw = [c for c in df.columns if c != row_column]
    return df.select(F.col(row_column).cast("bigint").alias("row_number"), text(first_name).alias("first_name"),
                     text(last_name).alias("last_name"), text(dob).alias("dob_raw"),
                     parse_dob(text(dob)).alias("dob"), raw_map(raw).alias("raw"))


def read_demographic_requests(spark: SparkSession, path: str, first_name: str = "FirstName",
                              last_name: str = "LastName", dob: str = "DOB", row_column: str | None = None,
                              multi_line: bool = True) -> DataFrame:
    """Demographic requests of a CSV file; no rows when the file or one of the columns is missing.

    For ``multi_line`` see :func:`read_id_requests`.
    """
    df = _read_csv(spark, path, [first_name, last_name, dob], multi_line)
    if df is None:
        return spark.createDataFrame([], "row_number bigint, first_name string, last_name string, "
                                         "dob_raw string, dob date, raw map<string,string>")
    return demographic_requests(_numbered(df, row_column), first_name, last_name, dob)
