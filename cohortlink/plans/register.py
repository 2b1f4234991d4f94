"""The queries on the benchmark tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import (LinkConfig, TableSpec, all_patients, audit_log, best_matches, by_birth_years, by_demographics, by_id,
                by_last_name, clean_html, compact_matches, demographic_misses, demographic_outcomes,
                demographic_summary, distinct_people, flat_matches, fuzzy_link, fuzzy_outcomes, fuzzy_search, fuzzy_top, grouped_report,
                id_failures, id_summary, json_documents, link_tables, lookup_by_demographics, lookup_by_id,
                mask_preview, mask_user, redact_dates, redact_secrets, redundant, run_summary, run_template,
                search_line, section_rows, similarity, split_counts, text_report, value_lines)
from ..functions.compare import compare_dates, compare_names, rounded
from ..operators.lookup import with_diagnoses
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Three fields must agree: what is linked grows with the tables, not with their square.
STRICT = LinkConfig(min_score=0.75)

TEMPLATE = """
SELECT p.PatientID, p.Name, p.Geburtsdatum, d.ICD10
FROM {people} p LEFT JOIN {findings} d ON p.PatientID = d.PatientID AND d.Bezeichnung = ?
WHERE p.Geburtsdatum BETWEEN ? AND ? AND (? IS NULL OR p.Name = ?) AND p.Vorname IN (?, ?)
ORDER BY p.PatientID;
"""
TEMPLATE_ARGS = ["F", date(1960, 1, 1), date(1989, 12, 31), "ring", "ring", "red", "old"]


def _plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text and nested columns as JSON, so that any engine's result compares."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(f.name)
        return c
    return df.select(*[plain(f) for f in df.schema])


def query(make: Query) -> Query:
    QUERIES[make.__name__] = lambda spark, folder: _plain(make(spark, folder))
    return make


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("overall_score", rounded(F.col("overall_score"), 6))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """People and diagnoses joined, the input of the reports."""
    people = views.patients(spark, folder).select("PatientID", "Vorname", "Name", "Geburtsdatum", "Dauernotiz")
    return people.join(views.diagnoses(spark, folder).hint("merge"), "PatientID", "left")


RECORD_ORDER = ["Date", "ICD10", "Bezeichnung"]


@query
def q_scan(spark, folder):
    return all_patients(views.patients(spark, folder))


@query
def q_lookup_id(spark, folder):
    return by_id(views.patients(spark, folder), 42, views.diagnoses(spark, folder))


@query
def q_lookup_demo(spark, folder):
    return by_demographics(views.patients(spark, folder), "small", "ring", date(1950, 1, 1))


@query
def q_lastname_like(spark, folder):
    return by_last_name(views.patients(spark, folder), "wi")


@query
def q_dob_year_range(spark, folder):
    return by_birth_years(views.patients(spark, folder), 1970, 1979)


@query
def q_template(spark, folder):
    return run_template(spark, TEMPLATE, TEMPLATE_ARGS, people=views.patients(spark, folder),
                        findings=views.diagnoses(spark, folder))


@query
def q_patient_diag(spark, folder):
    return with_diagnoses(views.patients(spark, folder), views.diagnoses(spark, folder))


def _specs(spark, folder):
    return (TableSpec("patients", views.patients(spark, folder), ["PatientID", "Vorname", "Name"]),
            [TableSpec("diagnoses", views.diagnoses(spark, folder)),
             TableSpec("contacts", views.contacts(spark, folder), ["Name", "Segment"])])


def _link(how: str):
    def make(spark, folder):
        primary, others = _specs(spark, folder)
        return link_tables(primary, others, views.id_list(spark, folder), how)
    make.__name__ = f"q_link_{how.lower()}"
    return make


for _how in ("LEFT", "INNER", "RIGHT", "FULL"):
    query(_link(_how))


@query
def q_link_where(spark, folder):
    primary, others = _specs(spark, folder)
    return link_tables(primary, others, how="INNER", where=[
        F.col("ICD10").like("A%"), F.col("Date") >= F.lit(date(1998, 1, 1))])


@query
def q_topn(spark, folder):
    primary, others = _specs(spark, folder)
    return link_tables(primary, others, how="INNER", limit=100,
                       order_by=["Date DESC", "PatientID", "ICD10", "Bezeichnung"])


@query
def q_link_limit_per_id(spark, folder):
    primary, others = _specs(spark, folder)
    return link_tables(primary, others[:1], views.id_list(spark, folder), limit=3,
                       order_by=["Date DESC", "ICD10", "Bezeichnung"])


@query
def q_batch_ids(spark, folder):
    return lookup_by_id(views.patients(spark, folder), views.id_list(spark, folder), views.diagnoses(spark, folder))


@query
def q_batch_ids_summary(spark, folder):
    return id_summary(views.id_list(spark, folder))


@query
def q_batch_ids_failed(spark, folder):
    return id_failures(views.id_list(spark, folder))


@query
def q_batch_demo(spark, folder):
    return lookup_by_demographics(views.patients(spark, folder), views.requests(spark, folder))


@query
def q_batch_demo_outcome(spark, folder):
    return demographic_outcomes(views.patients(spark, folder), views.requests(spark, folder))


@query
def q_batch_demo_misses(spark, folder):
    return demographic_misses(views.patients(spark, folder), views.requests(spark, folder)).select("row_number", "dob_raw")


@query
def q_batch_demo_summary(spark, folder):
    return demographic_summary(demographic_outcomes(views.patients(spark, folder), views.requests(spark, folder)))


def _paired(spark, folder):
    """Each request beside the person it was made from."""
    people = views.patients(spark, folder).withColumn("row_number", F.col("PatientID") + 1)
    return views.requests(spark, folder).join(people, "row_number")


@query
def q_similarity(spark, folder):
    pairs = _paired(spark, folder)
    return pairs.select("row_number", F.round(similarity(F.col("last_name"), F.col("Name")), 6).alias("last_names"),
                        F.round(similarity(F.col("Vorname"), F.col("Name")), 6).alias("first_and_last"))


def _info(df, name, info):
    df = df.select("row_number", F.explode(F.array(info)).alias("i")).select("row_number", "i.*")
    return df.withColumn("similarity_score", F.round("similarity_score", 6))


@query
def q_compare_names(spark, folder):
    return _info(_paired(spark, folder), "LastName", compare_names("LastName", F.col("last_name"), F.col("Name")))


@query
def q_compare_dates(spark, folder):
    return _info(_paired(spark, folder), "DOB", compare_dates(F.col("dob"), F.col("Geburtsdatum")))


@query
def q_fuzzy_one(spark, folder):
    return _rounded(fuzzy_search(views.patients(spark, folder), "red", "widgt", date(1975, 6, 15))) \
        .select("PatientID", "overall_score", "primary_match_type")


@query
def q_fuzzy_one_name(spark, folder):
    return _rounded(fuzzy_search(views.patients(spark, folder), "old", "pla")) \
        .select("PatientID", "overall_score", "primary_match_type")


@query
def q_fuzzy_one_any(spark, folder):
    return _rounded(fuzzy_search(views.patients(spark, folder), "smal", config=LinkConfig(min_score=0.0))) \
        .select("PatientID", "overall_score", "primary_match_type")


def _matches(spark, folder, diagnoses=None):
    return _rounded(fuzzy_link(views.patients(spark, folder), views.requests(spark, folder), STRICT, diagnoses))


@query
def q_fuzzy_batch(spark, folder):
    return _matches(spark, folder).select("csv_input_row_number", "csv_input_data", "PatientID", "overall_score",
                                          "primary_match_type")


@query
def q_fuzzy_top1(spark, folder):
    return best_matches(_matches(spark, folder)).select("csv_input_row_number", "PatientID", "overall_score", "rank")


@query
def q_fuzzy_diag(spark, folder):
    return _matches(spark, folder, views.diagnoses(spark, folder)) \
        .select("csv_input_row_number", "PatientID", "overall_score", "ICD10", "DiagnoseBezeichnung")


@query
def q_fuzzy_flat(spark, folder):
    flat = flat_matches(_matches(spark, folder).drop("csv_input_data"))
    return flat.withColumns({f"{n}_similarity": F.round(f"{n}_similarity", 6) for n in ("FirstName", "LastName", "DOB")})


@query
def q_fuzzy_detail(spark, folder):
    return _matches(spark, folder).select("csv_input_row_number", "PatientID", F.explode("match_fields_info").alias("i")) \
        .select("csv_input_row_number", "PatientID", "i.field_name", "i.input_value", "i.db_value", "i.match_type")


@query
def q_fuzzy_compact(spark, folder):
    return compact_matches(_matches(spark, folder))


def _varied(spark, folder):
    """People of whom some have no last name, and requests of which some give none."""
    people = views.patients(spark, folder).withColumn("Name", F.when(F.col("PatientID") % 19 != 4, F.col("Name")))
    asked = views.requests(spark, folder).withColumn("last_name", F.when(F.col("row_number") % 23 == 5, "").otherwise(F.col("last_name")))
    return people, asked


def _default_matches(spark, folder):
    return _rounded(fuzzy_link(*_varied(spark, folder)))


@query
def q_fuzzy_default(spark, folder):
    return _default_matches(spark, folder).select("csv_input_row_number", "PatientID", "overall_score", "primary_match_type")


@query
def q_fuzzy_default_top3(spark, folder):
    """The three best of each request by a threshold algorithm in rounds, not out of all matches."""
    return _rounded(fuzzy_top(*_varied(spark, folder), 3)).select("csv_input_row_number", "PatientID", "overall_score", "rank")


@query
def q_fuzzy_low(spark, folder):
    """A batch at a low threshold and score: alike names by prefix filtering, at threshold 0.6 and a least score of 0.05."""
    low = LinkConfig(threshold=0.6, min_score=0.05)
    return _rounded(fuzzy_link(*_varied(spark, folder), low)) \
        .select("csv_input_row_number", "PatientID", "overall_score", "primary_match_type")


@query
def q_fuzzy_outcome(spark, folder):
    people, asked = _varied(spark, folder)
    return fuzzy_outcomes(fuzzy_link(people, asked, STRICT), asked)


@query
def q_html_clean(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", clean_html("html").alias("text"))


@query
def q_redact_secrets(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", redact_secrets(F.col("text")).alias("text"))


@query
def q_redact_dates(spark, folder):
    day = F.col("o_orderdate")
    text = F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"), F.lit(", by "), F.date_format(day, "M/d/yyyy"),
                    F.lit(" or "), F.date_format(day, "dd.MM.yyyy"), F.lit("; no. "), "o_orderkey")
    return spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", redact_dates(text).alias("text"))


@query
def q_mask_user(spark, folder):
    return spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", mask_user(F.col("c_name")).alias("masked"))


@query
def q_mask_preview(spark, folder):
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        "c_custkey", mask_preview(F.col("c_name")).alias("name"), mask_preview(F.col("c_mktsegment")).alias("segment"))


@query
def q_distinct_patients(spark, folder):
    return distinct_people(views.patients(spark, folder))


@query
def q_group_report(spark, folder):
    report = grouped_report(_records(spark, folder), RECORD_ORDER)
    codes = F.array_join(F.transform("records", lambda r: F.concat_ws("|", r["Date"].cast("string"), r["ICD10"])), ";")
    return report.select("PatientID", "n_records", "patient_info.Name", "patient_info.Vorname", codes.alias("codes"))


@query
def q_group_runs(spark, folder):
    rows = lookup_by_id(views.patients(spark, folder), views.id_list(spark, folder))
    report = grouped_report(rows, ["row_number"], mode="runs")
    return report.select("run", "n_records", "patient_info.Name", "patient_info.Vorname", "patient_info.PatientID",
                         F.col("records")[0]["row_number"].alias("first_row"))


@query
def q_redundant_flag(spark, folder):
    return redundant(_records(spark, folder), ["PatientID", *RECORD_ORDER])


@query
def q_txt_lines(spark, folder):
    return value_lines(views.patients(spark, folder), ["PatientID"])


@query
def q_txt_report(spark, folder):
    return text_report(_records(spark, folder), RECORD_ORDER)


@query
def q_section_rows(spark, folder):
    return section_rows(_records(spark, folder), RECORD_ORDER)


@query
def q_json_doc(spark, folder):
    return json_documents(_records(spark, folder), RECORD_ORDER)


@query
def q_json_records(spark, folder):
    return json_documents(_records(spark, folder), RECORD_ORDER, whole_rows=True)


@query
def q_split_keys(spark, folder):
    return split_counts(views.patients(spark, folder), "{Vorname}_{Name}/{Geburtsdatum}")


@query
def q_split_keys_unnamed(spark, folder):
    """Names of letters that no key may hold."""
    people = views.patients(spark, folder).withColumn("Name", F.when(F.col("PatientID") % 5 == 0, "üß").otherwise(F.col("Name")))
    return split_counts(people, "{Name}")


@query
def q_run_status(spark, folder):
    ids = views.id_list(spark, folder)
    summary = run_summary(lookup_by_id(views.patients(spark, folder), ids), "get_patient_by_id", id_summary(ids),
                          {"input_csv": "orders-of-2024-01-31.csv", "id_column": "PatientID"}, duration_ms=0)
    return summary.drop("query_timestamp_utc", "query_display_name")


@query
def q_audit_log(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_type").alias("operation"), (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("duration_ms"), F.col("user_id").alias("row_count"))
    return audit_log(events).withColumn("search", search_line(
        F.col("operation"), F.lit(3), F.col("row_count"), F.col("duration_ms")))
