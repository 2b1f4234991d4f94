"""People, diagnoses and requests derived from the benchmark tables, every row of which is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.requests import demographic_requests, id_requests


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def patients(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", " ")
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("p_partkey") * 7919 % 20000).cast("int"))
    return _table(spark, folder, "part").select(
        F.col("p_partkey").alias("PatientID"), words[0].alias("Vorname"), words[1].alias("Name"),
        born.alias("Geburtsdatum"), F.col("p_brand").alias("Grunderkrankung"),
        F.lit(None).cast("string").alias("ET_Grunderkrankung"), F.col("p_type").alias("Dauernotiz"),
        F.lit(None).cast("string").alias("Dauernotiz_Diagnose"))


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("PatientID"), F.concat("l_returnflag", F.lit("."), "l_linenumber").alias("ICD10"),
        F.col("l_linestatus").alias("Bezeichnung"), F.to_date("l_shipdate").alias("Date"))


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("PatientID"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Segment"))


def id_list(spark: SparkSession, folder: str) -> DataFrame:
    """An id per order: some asked for many times, some unknown, some not numbers, some blank."""
    key, person = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(key % 7 == 0, F.concat(F.lit("x"), person)).when(key % 11 == 0, "  ") \
        .otherwise(F.concat(F.lit(" "), person * 2))
    df = _table(spark, folder, "orders").select((key + 1).alias("row_number"), text.alias("PatientID"))
    return id_requests(df)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """A request per person: some with a letter lost, a year off, a name or birth date missing or unreadable."""
    key, born = F.col("PatientID"), F.col("Geburtsdatum")
    last = F.when(key % 3 == 0, F.concat(F.substring("Name", 1, 1), F.expr("substring(Name, 3)"))).otherwise(F.col("Name"))
    dob = F.when(key % 13 == 3, "bad").when(key % 17 == 5, "") \
        .when(key % 7 == 0, F.add_months(born, 12).cast("string")).otherwise(born.cast("string"))
    df = patients(spark, folder).select(
        (key + 1).alias("row_number"), F.when(key % 11 == 3, "").otherwise(F.col("Vorname")).alias("FirstName"),
        last.alias("LastName"), dob.alias("DOB"))
    return demographic_requests(df)
