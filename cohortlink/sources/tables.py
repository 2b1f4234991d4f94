"""Readers for the person and child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Table of the session catalog, named ``schema.table``."""
    return spark.table(name)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, id_column: str, lower: int, upper: int,
              partitions: int, properties: dict | None = None) -> DataFrame:
    """Database table read in parallel id ranges; filters and column choice reach the database."""
    return spark.read.jdbc(url, table, column=id_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})
