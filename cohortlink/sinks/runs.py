"""Run summaries with their status, and audit lines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import mask_preview, mask_user, redact_dates, redact_secrets
from ..model import (BATCH_ALL, BATCH_EMPTY, BATCH_NONE, BATCH_PARTIAL, RUN_PARAMETERS, SUCCESS, SUCCESS_NO_DATA)

VERSION = "0.1.0"


def run_status(rows: Column, total: Column | None = None, processed: Column | None = None) -> Column:
    """State of a run from the number of result rows and, for a batch, its counters."""
    if total is None:
        return F.when(rows > 0, SUCCESS).otherwise(SUCCESS_NO_DATA)
    return F.when((rows > 0) & (processed == total), BATCH_ALL).when((rows > 0) & (processed > 0), BATCH_PARTIAL) \
        .when((rows > 0) | (total > 0), BATCH_NONE).otherwise(BATCH_EMPTY)


def run_parameters(values: dict, in_clear: bool = False) -> Column:
    """Known parameters that are set, as text; dates and long values hidden unless told otherwise."""
    cells = []
    for name in RUN_PARAMETERS:
        if values.get(name) is not None:
            value = F.lit(str(values[name]))
            cells += [F.lit(name), value if in_clear else mask_preview(redact_dates(value))]
    return F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")


def run_summary(results: DataFrame | int, name: str, counters: DataFrame | None = None, parameters: dict | None = None,
                display_name: str | None = None, started: datetime | None = None, duration_ms: int | None = None,
                in_clear: bool = False) -> DataFrame:
    """One row on a run: when, what, how long, how many rows, and its status.

    ``results`` is the number of rows where it is known, as from ``write_results``, else the rows are counted.
    ``counters`` holds one row ``total, processed, failed``; failures in detail stay a table of their own.
    """
    started = started or datetime.now(timezone.utc)
    if isinstance(results, int):
        df = SparkSession.active().range(1).select(F.lit(results).cast("bigint").alias("row_count_fetched"))
    else:
        df = results.agg(F.count("*").alias("row_count_fetched"))
    status = run_status(F.col("row_count_fetched"))
    if counters is not None:
        # Both sides hold exactly one row.
        df = df.withColumn("_one", F.lit(1)).join(counters.withColumn("_one", F.lit(1)), "_one").drop("_one")
        status = run_status(F.col("row_count_fetched"), F.col("total"), F.col("processed"))
    return df.select(F.lit(started.isoformat()).alias("query_timestamp_utc"), F.lit(name).alias("query_name"),
                     F.lit(display_name or name).alias("query_display_name"), F.lit(VERSION).alias("tool_version"),
                     F.lit(duration_ms).cast("bigint").alias("execution_duration_ms"), *df.columns,
                     run_parameters(parameters or {}, in_clear).alias("parameters"), status.alias("status"))


def _state(success: Column) -> Column:
    return F.when(success, "SUCCESS").otherwise("FAILED")


def _ms(duration: Column, form: str) -> Column:
    return F.when(duration.isNotNull(), F.format_string(form, duration.cast("double"))).otherwise("")


def operation_line(operation: Column, success: Column, duration_ms: Column, rows: Column) -> Column:
    """Audit line of a database operation."""
    return F.concat(F.lit("DB_AUDIT: "), operation, F.lit(" "), _state(success), _ms(duration_ms, ", %.2fms"),
                    F.when(rows.isNotNull(), F.concat(F.lit(", "), rows.cast("string"), F.lit(" rows"))).otherwise(""))


def search_line(kind: Column, criteria: Column, results: Column, duration_ms: Column) -> Column:
    """Audit line of a search for people."""
    return F.concat(F.lit("PATIENT_SEARCH: "), kind, F.lit(" search with "), criteria.cast("string"),
                    F.lit(" criteria returned "), results.cast("string"), F.lit(" results"), _ms(duration_ms, " (%.2fms)"))


def login_line(event: Column, user: Column, success: Column, details: Column) -> Column:
    """Audit line of a login, the user masked and the details redacted."""
    hidden = redact_dates(redact_secrets(details))
    return F.concat(F.lit("AUTH: "), event, F.lit(" "), _state(success),
                    F.when(F.length(user) > 0, F.concat(F.lit(" user="), mask_user(user))).otherwise(""),
                    F.when(F.length(details) > 0, F.concat(F.lit(" | "), hidden)).otherwise(""))


def audit_log(events: DataFrame, operation: str = "operation", success: str = "success", duration: str = "duration_ms",
              rows: str = "row_count") -> DataFrame:
    """Audit rows with their line, ready to append to a table."""
    line = operation_line(F.col(operation), F.col(success), F.col(duration), F.col(rows))
    return events.select(F.col(operation).alias("operation"), _state(F.col(success)).alias("status"),
                         F.col(duration).cast("double").alias("duration_ms"), F.col(rows).cast("bigint").alias("row_count"),
                         line.alias("line"))
