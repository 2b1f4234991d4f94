"""Column names, default settings and fixed values shared by the package."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ID = "PatientID"

PATIENT_SCHEMA = T.StructType([
    T.StructField("PatientID", T.LongType(), False),
    T.StructField("Vorname", T.StringType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Geburtsdatum", T.DateType()),
    T.StructField("Grunderkrankung", T.StringType()),
    T.StructField("ET_Grunderkrankung", T.StringType()),
    T.StructField("Dauernotiz", T.StringType()),
    T.StructField("Dauernotiz_Diagnose", T.StringType()),
])
PATIENT_COLS = PATIENT_SCHEMA.fieldNames()

DIAGNOSIS_SCHEMA = T.StructType([
    T.StructField("PatientID", T.LongType(), False),
    T.StructField("ICD10", T.StringType()),
    T.StructField("Bezeichnung", T.StringType()),
])

# Report fields that describe the person, and fields that vary per record.
PATIENT_FIELDS = ["Name", "Vorname", "PatientID", "FirstName", "LastName", "Geburtsdatum", "DOB"]
VARYING_FIELDS = ["ICD10", "Bezeichnung", "Diagnosis", "Code", "Description"]

# Parameters that a run summary may carry.
RUN_PARAMETERS = ["first_name", "last_name", "dob", "patient_id", "query_name", "table_name",
                  "table_schema", "input_csv", "id_column"]

# Run states.
SUCCESS = "success"
SUCCESS_NO_DATA = "success_no_data"
BATCH_ALL = "batch_success_all_processed"
BATCH_PARTIAL = "batch_partial_success"
BATCH_NONE = "batch_processed_no_data_or_all_failed"
BATCH_EMPTY = "batch_input_error_or_empty"

# Reasons recorded for rejected requests.
BAD_ID = "Invalid ID format"
NO_NAME = "Missing first name or last name"
BAD_DOB = "Invalid DOB format: "
NO_DOB = "DOB is required for exact match"
NO_MATCH = "No matching patient found"
NO_CRITERIA = "At least one search parameter is required for fuzzy search"

# Notes on compared fields.
NO_INPUT_NAME = "Input name not provided"
NO_STORED_NAME = "DB name not provided"
NO_INPUT_DOB = "Input DOB not provided"
NO_STORED_DOB = "DB DOB not provided"
YEARS_APART = "Year diff: "

# Output formats, and the file endings that imply them.
FORMATS = ["json", "csv", "tsv", "txt"]
FORMAT_BY_SUFFIX = {".json": "json", ".csv": "csv", ".tsv": "tsv", ".txt": "txt"}

# Weight per field and score per match type.
WEIGHTS = {"LastName": 0.4, "FirstName": 0.3, "DOB": 0.3}
SCORES = {"Exact": 1.0, "Fuzzy": "use_similarity", "YearMismatch": 0.7,
          "MissingDBValue": -0.1, "Mismatch": 0.0, "NotCompared": 0.0}


@dataclass(frozen=True)
class LinkConfig:
    """Settings of the fuzzy linkage; ``min_score`` is the lowest overall score kept."""

    id_col: str = ID
    first_name: str = "Vorname"
    last_name: str = "Name"
    dob: str = "Geburtsdatum"
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    scores: dict = field(default_factory=lambda: dict(SCORES))
    threshold: float = 0.85
    year_tolerance: int = 1
    min_score: float = 0.3
    ignore_case: bool = False

    def __post_init__(self):
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must lie between 0 and 1")
        # Partial settings are laid over the defaults, key by key.
        object.__setattr__(self, "weights", {**WEIGHTS, **self.weights})
        object.__setattr__(self, "scores", {**SCORES, **self.scores})
