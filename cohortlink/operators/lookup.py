"""Exact lookups: by id, by demographics, by last-name pattern, by year of birth, by SQL template."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_strings
from ..model import BAD_DOB, BAD_ID, ID, NO_DOB, NO_MATCH, NO_NAME, PATIENT_COLS
from .skew import among, padded


def patient_columns(patients: DataFrame) -> DataFrame:
    return patients.select(*PATIENT_COLS)


def all_patients(patients: DataFrame) -> DataFrame:
    """Every column of the person table."""
    return patients.alias("p").select("p.*")


def filtered(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet every condition."""
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def with_diagnoses(patients: DataFrame, diagnoses: DataFrame | None, id_column: str = ID,
                   ids: DataFrame | None = None) -> DataFrame:
    """People with their diagnoses; those without any are kept.

    Nothing bounds the size of a child table, so it is never broadcast: both sides are shuffled by
    person, where the adaptive planner splits people with very many rows (see :func:`padded`). ``ids``
    may name the people where that is cheaper than reading ``patients`` for them.
    """
    if diagnoses is None:
        return patients
    child = diagnoses.select(F.col(id_column), "ICD10", F.col("Bezeichnung").alias("DiagnoseBezeichnung"))
    child = padded(child, id_column, patients if ids is None else ids).withColumnRenamed(id_column, "_child")
    return patients.join(child.hint("merge"), F.col(id_column).eqNullSafe(F.col("_child"))).drop("_child")


def by_id(patients: DataFrame, patient_id: int, diagnoses: DataFrame | None = None) -> DataFrame:
    return with_diagnoses(patient_columns(patients).where(F.col(ID) == patient_id), diagnoses)


def by_demographics(patients: DataFrame, first_name: str, last_name: str, dob,
                    diagnoses: DataFrame | None = None) -> DataFrame:
    hits = filtered(patient_columns(patients), F.col("Vorname") == first_name, F.col("Name") == last_name,
                    F.to_date("Geburtsdatum") == F.lit(dob).cast("date"))
    return with_diagnoses(hits, diagnoses)


def name_pattern(text: str) -> str:
    """LIKE pattern: a prefix, unless the text holds wildcards of its own."""
    return text if "%" in text or "_" in text else f"{text}%"


def by_last_name(patients: DataFrame, text: str, ignore_case: bool = False,
                 diagnoses: DataFrame | None = None) -> DataFrame:
    c = F.col("Name")
    hit = c.ilike(name_pattern(text)) if ignore_case else c.like(name_pattern(text))
    return with_diagnoses(patient_columns(patients).where(hit), diagnoses)


def year_range(column: str, first: int, last: int) -> Column:
    """Dates of the given years, both included, as a range the scan can use."""
    return (F.col(column) >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & \
        (F.col(column) < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1)))


def by_birth_years(patients: DataFrame, first: int, last: int, diagnoses: DataFrame | None = None) -> DataFrame:
    return with_diagnoses(patient_columns(patients).where(year_range("Geburtsdatum", first, last)), diagnoses)


def lookup_by_id(patients: DataFrame, requests: DataFrame, diagnoses: DataFrame | None = None,
                 clean: bool = True) -> DataFrame:
    """One row per request and person found (and diagnosis); a repeated id gives its rows again."""
    hits = requests.where(F.col("id").isNotNull()).select("row_number", F.col("id").alias(ID))
    wanted = hits.select(ID).distinct()
    people = among(patient_columns(patients), wanted, ID)
    diagnoses = _wanted(diagnoses, wanted, clean)
    people = clean_strings(people) if clean else people
    return with_diagnoses(hits.join(people, ID), diagnoses, ids=wanted).select("row_number", *PATIENT_COLS, *_child(diagnoses))


def _wanted(diagnoses: DataFrame | None, ids: DataFrame, clean: bool) -> DataFrame | None:
    """The diagnoses of the people asked for; only their cells are cleaned."""
    if diagnoses is None:
        return None
    some = among(diagnoses.select(ID, "ICD10", "Bezeichnung"), ids, ID)
    return clean_strings(some) if clean else some


def _child(diagnoses: DataFrame | None) -> list[str]:
    return [] if diagnoses is None else ["ICD10", "DiagnoseBezeichnung"]


def id_failures(requests: DataFrame) -> DataFrame:
    """Rejected ids with the reason of their last occurrence."""
    return requests.where(F.col("id").isNull()).groupBy("raw_id") \
        .agg(F.max_by(F.lit(BAD_ID), "row_number").alias("reason"))


def id_summary(requests: DataFrame) -> DataFrame:
    """Counters of an id batch; an id that is a number counts as processed even when nobody has it."""
    return requests.agg(
        F.count("*").alias("total"), F.count("id").alias("processed"),
        F.countDistinct(F.when(F.col("id").isNull(), F.col("raw_id"))).alias("failed"))


def check_demographics(requests: DataFrame) -> DataFrame:
    """Add ``reason``: the first rule a request breaks, or null when it can be looked up."""
    nameless = (F.col("first_name") == "") | (F.col("last_name") == "")
    unread = (F.col("dob_raw") != "") & F.col("dob").isNull()
    return requests.withColumn(
        "reason", F.when(nameless, NO_NAME).when(unread, F.concat(F.lit(BAD_DOB), F.col("dob_raw")))
        .when(F.col("dob").isNull(), NO_DOB))


def _people_by_demographics(patients: DataFrame) -> DataFrame:
    return patients.withColumns({"first_name": F.col("Vorname"), "last_name": F.col("Name"),
                                 "dob": F.to_date("Geburtsdatum")})


_KEYS = ["first_name", "last_name", "dob"]


def lookup_by_demographics(patients: DataFrame, requests: DataFrame, diagnoses: DataFrame | None = None,
                           clean: bool = True) -> DataFrame:
    """People whose names and birth date equal those of a valid request."""
    valid = check_demographics(requests).where(F.col("reason").isNull())
    hits = valid.join(_people_by_demographics(patient_columns(patients)), _KEYS)
    found = hits.select("row_number", "raw", *PATIENT_COLS)
    ids = found.select(ID).distinct()
    if clean:
        found = clean_strings(found, [c for c, kind in found.dtypes if kind == "string"])
    diagnoses = _wanted(diagnoses, ids, clean)
    return with_diagnoses(found, diagnoses, ids=ids).select("row_number", "raw", *PATIENT_COLS, *_child(diagnoses))


def demographic_outcomes(patients: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: why it failed, or null when somebody was found."""
    checked = check_demographics(requests)
    people = _people_by_demographics(patients.select("Vorname", "Name", "Geburtsdatum")) \
        .select(*_KEYS).distinct().withColumn("_found", F.lit(True))
    missed = F.when(F.col("reason").isNull() & F.col("_found").isNull(), NO_MATCH).otherwise(F.col("reason"))
    return checked.join(people, _KEYS, "left").select("row_number", missed.alias("reason"))


def demographic_misses(patients: DataFrame, requests: DataFrame) -> DataFrame:
    """Valid requests nobody answers to."""
    valid = check_demographics(requests).where(F.col("reason").isNull())
    return valid.join(_people_by_demographics(patients).select(*_KEYS), _KEYS, "left_anti").drop("reason")


def demographic_summary(outcomes: DataFrame) -> DataFrame:
    """Counters of a demographics batch; only requests that found somebody count as processed."""
    return outcomes.agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("processed"),
                        F.count_if(F.col("reason").isNotNull()).alias("failed"))


_PLACEHOLDER = re.compile(r"""'(?:[^']|'')*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(\?)""", re.DOTALL)


def run_template(spark: SparkSession, text: str, args: list | None = None, **views: DataFrame) -> DataFrame:
    """Run a SELECT with ``?`` placeholders; values travel as arguments, and so do tables, which stand
    in braces: ``FROM {people} p``. Views of the session stay as they are.

    Placeholders become named parameters in the order they stand in the text; those inside quotes
    and comments are text.
    """
    values = list(args or [])
    named: dict[str, object] = {}

    def name_it(found: re.Match) -> str:
        if found.group(1) is None:
            return found.group(0)
        if len(named) == len(values):
            raise ValueError("more placeholders than values")
        name = f"value_{len(named)}"
        named[name] = values[len(named)]
        return f":{name}"
    text = _PLACEHOLDER.sub(name_it, text.strip().rstrip(";"))
    if len(named) < len(values):
        raise ValueError("more values than placeholders")
    return spark.sql(text, args=named, **views)
