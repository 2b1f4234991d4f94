"""Tables and columns of a catalog as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = ("table_schema string, table_name string, table_type string, column_name string, data_type string, "
           "is_nullable boolean, ordinal_position int")

# What the summary says about a table without columns.
NO_COLUMNS = "No columns found or table not accessible."
NO_TABLE = "Table metadata not found or table empty/inaccessible"


def catalog_of(tables: dict[str, DataFrame], schema: str = "default") -> DataFrame:
    """Catalog rows of DataFrames at hand; only their schemas are read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(schema, name, "BASE TABLE", f.name, f.dataType.simpleString(), f.nullable, i)
            for name, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, _SCHEMA)


def session_catalog(spark: SparkSession, schema: str) -> DataFrame:
    """Catalog rows of a schema of the session catalog."""
    rows = []
    for table in spark.catalog.listTables(schema):
        kind = "VIEW" if table.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE"
        name = table.name if table.isTemporary else f"{schema}.{table.name}"
        for i, c in enumerate(spark.catalog.listColumns(name), 1):
            rows.append((schema, table.name, kind, c.name, c.dataType, c.nullable, i))
    return spark.createDataFrame(rows, _SCHEMA)


def _tables(catalog: DataFrame) -> DataFrame:
    return catalog.select("table_schema", "table_name", "table_type").distinct()


def _columns_text(separator: str):
    described = F.concat(F.col("column_name"), F.lit(" ("), F.col("data_type"), F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", described.alias("text")))),
                        lambda c: c["text"])
    return F.array_join(lines, separator)


def list_tables(catalog: DataFrame) -> DataFrame:
    """Base tables with the number and the list of their columns."""
    base = _tables(catalog).where(F.col("table_type") == "BASE TABLE")
    return base.join(catalog.drop("table_type"), ["table_schema", "table_name"]) \
        .groupBy("table_schema", "table_name") \
        .agg(F.count("*").alias("Column Count"), _columns_text("\r\n").alias("Columns")) \
        .select("table_schema", F.col("table_name").alias("Table Name"), "Column Count", "Columns") \
        .orderBy("Table Name", "table_schema")


def table_columns(catalog: DataFrame, table: str, schema: str) -> DataFrame:
    """Columns of one table in order."""
    return catalog.where((F.col("table_name") == table) & (F.col("table_schema") == schema)) \
        .select(F.col("column_name").alias("COLUMN_NAME"), F.col("data_type").alias("DATA_TYPE"),
                F.col("is_nullable").alias("IS_NULLABLE"), F.col("ordinal_position").alias("ORDINAL_POSITION")) \
        .orderBy("ORDINAL_POSITION")


def table_summary(catalog: DataFrame, table: str, schema: str) -> DataFrame:
    """One row on one table, also when it is not there."""
    there = catalog.where((F.col("table_name") == table) & (F.col("table_schema") == schema))
    found = there.agg(F.count("*").alias("n"), _columns_text("\n").alias("text"))
    return found.select(F.lit(table).alias("Table Name"), F.lit(schema).alias("Table Schema"),
                        F.col("n").alias("Column Count"),
                        F.when(F.col("n") > 0, F.col("text")).otherwise(NO_COLUMNS).alias("Columns"),
                        F.when(F.col("n") == 0, NO_TABLE).alias("Status"))


def discover_key_tables(catalog: DataFrame, schema: str, pattern: str = "(?i)patient_?id") -> DataFrame:
    """Base tables of a schema with a column whose name fits the pattern, and how many columns they have."""
    base = catalog.where((F.col("table_type") == "BASE TABLE") & (F.col("table_schema") == schema))
    sizes = base.groupBy("table_name", "table_schema").agg(F.count("*").alias("TOTAL_COLUMNS"))
    return base.where(F.col("column_name").rlike(pattern)).join(sizes, ["table_name", "table_schema"]) \
        .select(F.col("table_name").alias("TABLE_NAME"), F.col("table_schema").alias("TABLE_SCHEMA"),
                F.col("column_name").alias("PATIENT_ID_COLUMN"), "TOTAL_COLUMNS") \
        .orderBy("TABLE_NAME", "PATIENT_ID_COLUMN")
