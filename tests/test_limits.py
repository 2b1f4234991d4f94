"""Plans and counts that keep memory and time in bounds on large tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlink import LinkConfig, TableSpec, fuzzy_link, link_tables, lookup_by_id


def _people(spark, n=60):
    return spark.range(n).select(
        F.col("id").alias("PatientID"), F.lit("a").alias("Vorname"), F.lit("b").alias("Name"),
        F.lit("2000-01-01").cast("date").alias("Geburtsdatum"), *[
            F.lit("x").alias(c) for c in ("Grunderkrankung", "ET_Grunderkrankung", "Dauernotiz", "Dauernotiz_Diagnose")])


def _findings(spark, n=600):
    return spark.range(n).select((F.col("id") % 50).alias("PatientID"), F.concat(F.lit("I"), F.col("id")).alias("ICD10"),
                                 F.lit("b").alias("Bezeichnung"))


def _asked(spark):
    return spark.range(40).select(F.col("id").alias("row_number"), (F.col("id") * 2).alias("id"))


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_the_ids_asked_for_are_chosen_without_sorting(spark):
    found = lookup_by_id(_people(spark), _asked(spark), _findings(spark), clean=False)
    linked = link_tables(TableSpec("p", _people(spark), ["PatientID"]), [TableSpec("d", _findings(spark), ["ICD10"])],
                         _asked(spark), clean=False)
    for df in (found, linked):
        plan = _plan(df)
        assert "LeftSemi" in plan and "LeftAnti" in plan
        for line in plan.splitlines():
            assert "SortMergeJoin" not in line or not ("LeftSemi" in line or "LeftAnti" in line)
    # 25 even ids below 50 have twelve findings each, five up to 58 have none.
    assert found.count() == 25 * 12 + 5 and linked.count() == 25 * 12 + 5


def test_a_limit_per_id_cuts_the_sorted_table_before_the_join(spark):
    people, findings = _people(spark).unionByName(_people(spark)), _findings(spark)
    more = spark.range(120).select((F.col("id") % 40).alias("PatientID"), F.col("id").alias("Level"))
    others = [TableSpec("m", more, ["Level"]), TableSpec("d", findings, ["ICD10"])]
    out = link_tables(TableSpec("p", people, ["PatientID"]), others, _asked(spark), limit=8, order_by=["ICD10 DESC"], clean=False)
    rows = sorted((r.row_number, r.ICD10 or "") for r in out.collect())
    expected = []
    for i in range(40):
        codes = sorted((f"I{n}" for n in range(600) if n % 50 == 2 * i and 2 * i < 50), reverse=True) or [""]
        if 2 * i < 60:
            levels = 3 if 2 * i < 40 else 1
            expected += [(i, c) for c in [c for c in codes for _ in range(2 * levels)][:8]]
    assert rows == sorted(expected)
    # Ranked twice: the findings alone, then what the join makes of the first of them.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") >= 2


def test_names_are_compared_once_per_pair_of_names_not_per_pair_of_rows(spark):
    requests = _asked(spark).select("row_number", F.lit("a").alias("first_name"), F.lit("b").alias("last_name"),
                                    F.lit("2000-01-01").cast("date").alias("dob"))
    found = fuzzy_link(_people(spark), requests, LinkConfig(min_score=.75))
    assert found.count() == 40 * 60
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
