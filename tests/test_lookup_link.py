from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortlink import (TableSpec, by_birth_years, by_demographics, by_id, by_last_name, demographic_misses,
                        demographic_outcomes, demographic_requests, demographic_summary, id_failures, id_requests,
                        id_summary, link_tables, lookup_by_demographics, lookup_by_id, read_demographic_requests,
                        read_id_requests, run_template)
from cohortlink.operators.lookup import name_pattern, with_diagnoses


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_id_list(spark, tmp_path):
    path = write(tmp_path / "ids.csv", "PatientID,Other\n 1001 ,a\n1002,b\n   ,c\n,d\n1001,e\ninvalid,f\n")
    rows = sorted(tuple(r) for r in read_id_requests(spark, path).collect())
    assert rows == [(1, "1001", 1001), (2, "1002", 1002), (5, "1001", 1001), (6, "invalid", None)]


def test_id_list_with_mark_missing_column_and_missing_file(spark, tmp_path):
    path = write(tmp_path / "mark.csv", "PatientID\n7\n", "utf-8-sig")
    assert [r.id for r in read_id_requests(spark, path).collect()] == [7]
    assert read_id_requests(spark, path, "Nope").count() == 0
    assert read_id_requests(spark, str(tmp_path / "none.csv")).count() == 0
    assert read_id_requests(spark, write(tmp_path / "empty.csv", "")).count() == 0


def test_row_numbers_over_many_files_and_given_numbers(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f in range(3):
        write(folder / f"{f}.csv", "PatientID\n" + "".join(f"{f}{i:03d}\n" for i in range(100)))
    rows = read_id_requests(spark, str(folder)).orderBy("row_number").collect()
    assert [r.row_number for r in rows] == list(range(1, 301))
    assert [r.raw_id for r in rows] == [f"{f}{i:03d}" for f in range(3) for i in range(100)]
    path = write(tmp_path / "own.csv", "line,PatientID\n10,5\n20,6\n")
    assert sorted((r.row_number, r.id) for r in read_id_requests(spark, path, row_column="line").collect()) == [(10, 5), (20, 6)]


DEMOGRAPHICS = ("FirstName,LastName,DOB\nHans,Müller,1980-05-15\n Anna ,Schmidt,1975-12-03\nJohn,Johnson,1990-08-20\n"
                ",Invalid,1985-01-01\nJane,,1990-01-01\nBob,Test,invalid-date\nEve,Blank,\nNo,Body,2000-01-01\n")


def test_demographics(spark, tmp_path, patients, diagnoses):
    requests = read_demographic_requests(spark, write(tmp_path / "d.csv", DEMOGRAPHICS))
    raw = {r.row_number: r for r in requests.collect()}
    assert raw[2].first_name == "Anna" and raw[2].raw["FirstName"] == " Anna " and raw[1].dob == date(1980, 5, 15)
    found = lookup_by_demographics(patients, requests, diagnoses)
    assert sorted((r.row_number, r.PatientID, r.ICD10) for r in found.collect() if r.ICD10) == [
        (1, 1001, "E11.9"), (1, 1001, "I10"), (2, 1002, "M79.1")]
    assert {r.Dauernotiz for r in found.collect()} == {"note", None}
    outcomes = demographic_outcomes(patients, requests)
    assert {r.row_number: r.reason for r in outcomes.collect()} == {
        1: None, 2: None, 3: None, 4: "Missing first name or last name", 5: "Missing first name or last name",
        6: "Invalid DOB format: invalid-date", 7: "DOB is required for exact match", 8: "No matching patient found"}
    assert tuple(demographic_summary(outcomes).first()) == (8, 3, 5)
    assert [r.row_number for r in demographic_misses(patients, requests).collect()] == [8]
    assert read_demographic_requests(spark, str(tmp_path / "d.csv"), dob="Born").count() == 0


def test_hits_and_misses_make_up_the_valid_requests(spark, patients):
    df = spark.createDataFrame([(i, f, "Müller", "1980-05-15") for i, f in enumerate(["Hans", "Hanz", "Hans", ""])],
                               "row_number int, FirstName string, LastName string, DOB string")
    requests = demographic_requests(df)
    hits = lookup_by_demographics(patients, requests).select("row_number").distinct().count()
    assert hits + demographic_misses(patients, requests).count() == 3


def test_id_batch(spark, patients, diagnoses):
    df = spark.createDataFrame([(1, "1001"), (2, " 1002"), (3, "9"), (4, "bad"), (5, "1001"), (6, ""), (7, "bad")],
                               "row_number int, PatientID string")
    requests = id_requests(df)
    found = lookup_by_id(patients, requests, diagnoses).collect()
    assert sorted((r.row_number, r.ICD10) for r in found) == [(1, "E11.9"), (1, "I10"), (2, "M79.1"), (5, "E11.9"), (5, "I10")]
    assert tuple(id_summary(requests).first()) == (6, 4, 1)
    assert [tuple(r) for r in id_failures(requests).collect()] == [("bad", "Invalid ID format")]


def test_single_lookups(spark, patients, diagnoses):
    assert [r.Name for r in by_id(patients, 1002).collect()] == ["Schmidt"]
    assert by_id(patients, 1003, diagnoses).first().ICD10 is None
    assert by_demographics(patients, "Hans", "Müller", date(1980, 5, 15)).count() == 1
    timed = patients.withColumn("Geburtsdatum", F.col("Geburtsdatum").cast("timestamp"))
    assert by_demographics(timed, "Hans", "Müller", date(1980, 5, 15)).count() == 1
    assert by_last_name(patients, "mü", ignore_case=True).count() == 1 and by_last_name(patients, "mü").count() == 0
    assert by_last_name(patients, "%son").count() == 1
    assert [r.PatientID for r in by_birth_years(patients, 1975, 1980).orderBy("PatientID").collect()] == [1001, 1002]
    assert [name_pattern(t) for t in ("Smith", "Sm%", "Sm_th", "")] == ["Smith%", "Sm%", "Sm_th", "%"]


def test_filters_reach_the_scan(spark, tmp_path, patients):
    patients.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    for df, pushed in ((by_id(stored, 1001), "EqualTo(PatientID,1001)"), (by_birth_years(stored, 1975, 1980), "GreaterThanOrEqual(Geburtsdatum"),
                       (by_last_name(stored, "Mü"), "StringStartsWith(Name,Mü)")):
        assert pushed in df._jdf.queryExecution().executedPlan().toString()


def test_template(spark, patients, diagnoses):
    text = """-- who? nobody knows
        SELECT p.Name, d.ICD10 FROM {people} p LEFT JOIN {findings} d ON p.PatientID = d.PatientID AND d.ICD10 <> ?
        WHERE p.PatientID IN (?, ?) AND (? IS NULL OR p.Name = ?) AND p.Geburtsdatum BETWEEN ? AND ? AND p.Name <> 'what?';"""
    args = ["I10", 1001, 1002, None, None, date(1970, 1, 1), date(1990, 1, 1)]
    got = run_template(spark, text, args, people=patients, findings=diagnoses).collect()
    assert sorted(map(tuple, got)) == [("Müller", "E11.9"), ("Schmidt", "M79.1")]
    with pytest.raises(ValueError):
        run_template(spark, text, args[:-1], people=patients, findings=diagnoses)
    with pytest.raises(ValueError):
        run_template(spark, text, args + [1], people=patients, findings=diagnoses)


def test_template_leaves_views_alone(spark, patients, diagnoses):
    spark.range(3).createOrReplaceTempView("people")
    run_template(spark, "SELECT count(*) AS n FROM {people}", people=patients).collect()
    assert spark.table("people").count() == 3
    spark.catalog.dropTempView("people")


def test_only_the_cells_of_people_asked_for_are_cleaned(spark):
    """In the plan the cleaning stands above the semi join of every table."""
    from cohortlink.plans.register import QUERIES

    def below(node):
        nodes = [node]
        for i in range(node.children().size()):
            nodes += below(node.children().apply(i))
        return nodes
    for name in ("q_batch_ids", "q_link_left"):
        nodes = below(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
        cleaned = [n for n in nodes if n.nodeName() == "ArrowEvalPython"]
        assert cleaned
        for node in cleaned:
            assert any(n.nodeName() == "Join" and n.joinType().toString() == "LeftSemi" for n in below(node))


@pytest.mark.parametrize("link", [False, True])
def test_very_many_rows_of_one_person_are_split(spark, tmp_path, link):
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        people = spark.range(400).select(F.col("id").alias("PatientID"), F.lit("n").alias("Name"))
        many = spark.range(60_000).select(F.when(F.col("id") < 54_000, 7).otherwise(F.col("id") % 300).cast("bigint").alias("PatientID"),
                                          F.sha2(F.col("id").cast("string"), 256).alias("ICD10"), F.lit("b").alias("Bezeichnung"))
        out = (link_tables(TableSpec("p", people), [TableSpec("d", many, ["ICD10"])], clean=False) if link
               else with_diagnoses(people, many))
        rows = out.collect()
        assert len(rows) == 60_000 + 100 and sum(r.ICD10 is None for r in rows) == 100
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture
def specs(spark, patients, diagnoses):
    extra = spark.createDataFrame([(1001, "Frau M", 5), (77, "Nobody", 6)], "PatID bigint, Name string, Level int")
    return TableSpec("Patient", patients, ["PatientID", "Name"]), [TableSpec("Diagnose", diagnoses, ["ICD10"]),
                                                                  TableSpec("Contact", extra, [], "PatID")]


@pytest.mark.parametrize("how,ids", [("LEFT", [1001, 1001, 1002, 1003]), ("FULL", [1001, 1001, 1002, 1003]),
                                     ("INNER", [1001, 1001]), ("RIGHT", [1001, 1001])])
def test_star_join(specs, how, ids):
    out = link_tables(*specs, how=how)
    assert out.columns == ["PatientID", "Name", "ICD10", "PatID", "Contact_Name", "Level"]
    assert sorted(r.PatientID for r in out.collect()) == ids


def test_star_join_for_ids_order_and_limit(spark, specs):
    assert link_tables(*specs, ids=1002).collect()[0].ICD10 == "M79.1"
    requests = spark.createDataFrame([(1, "1001", 1001), (2, "x", None), (3, "1001", 1001), (4, "1002", 1002)],
                                     "row_number bigint, raw_id string, id bigint")
    rows = link_tables(*specs, ids=requests, order_by=["ICD10 DESC"], limit=1).collect()
    assert [(r.row_number, r.ICD10) for r in rows] == [(1, "I10"), (3, "I10"), (4, "M79.1")]
    rows = link_tables(*specs, order_by=["ICD10 DESC"], limit=2).collect()
    assert [r.ICD10 for r in rows] == ["M79.1", "I10"]
    assert link_tables(*specs, limit=0).count() == 4
    assert link_tables(*specs, where=[F.col("ICD10") == "I10", F.col("Level") > 4]).count() == 1


def test_star_join_refuses_what_it_cannot_do(specs):
    with pytest.raises(ValueError):
        link_tables(*specs, how="SIDEWAYS")
    with pytest.raises(ValueError):
        link_tables(*specs, order_by=["ICD10 UP"])
    with pytest.raises(ValueError):
        link_tables(specs[0], [specs[1][1], specs[1][1]])


def test_full_join_under_the_id_filter_is_no_full_join(specs):
    plan = link_tables(*specs, ids=1001, how="FULL")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
    plan = link_tables(*specs, ids=1001, how="RIGHT")._jdf.queryExecution().optimizedPlan().toString()
    assert "RightOuter" not in plan
