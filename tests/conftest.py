import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cohortlink import with_settings
    session = with_settings(
        SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.shuffle.partitions", "8")).getOrCreate()
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


@pytest.fixture
def patients(spark):
    from datetime import date

    from cohortlink.model import PATIENT_SCHEMA
    rows = [(1001, "Hans", "Müller", date(1980, 5, 15), "x", None, "<p>note</p>", None),
            (1002, "Anna", "Schmidt", date(1975, 12, 3), None, None, None, None),
            (1003, "John", "Johnson", date(1990, 8, 20), None, None, None, None)]
    return spark.createDataFrame(rows, PATIENT_SCHEMA)


@pytest.fixture
def diagnoses(spark):
    from datetime import date
    return spark.createDataFrame(
        [(1001, "E11.9", "Diabetes mellitus, Type 2", date(2023, 1, 15)),
         (1001, "I10", "Essential hypertension", date(2023, 2, 20)), (1002, "M79.1", "Myalgia", date(2023, 3, 10))],
        "PatientID bigint, ICD10 string, Bezeichnung string, Date date")
