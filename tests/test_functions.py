import html
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cohortlink import (LinkConfig, clean_html, clean_strings, mask_preview, mask_user, redact, redact_secrets, similarity,
                        weighted_ratio)
from cohortlink.functions.compare import compare_dates, compare_names, match_label, overall_score, two_digits
from cohortlink.functions.similarity import common_letters
from cohortlink.functions.text import clean_text, parse_dob, parse_id, sanitise


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("cell,text", [
    ("Simple text", "Simple text"), ("M&uuml;ller &amp; Schmidt", "Müller & Schmidt"),
    ("Line 1<br>Line 2", "Line 1\nLine 2"), ("Line 1<br/>Line 2", "Line 1\nLine 2"), ("Line 1<BR>Line 2", "Line 1\nLine 2"),
    ("Line 1<br />Line 2", "Line 1\nLine 2"),
    ("<p>Paragraph</p><div>Content</div><strong>Bold</strong>", "Paragraph\nContent\nBold"),
    ("Line 1\n\n\n\nLine 2\n  \n\nLine 3", "Line 1\nLine 2\nLine 3"), ("   Content with spaces   ", "Content with spaces"),
    ("<p>HTML content</p><br>New line", "HTML content\nNew line"), ("&lt;script&gt;alert('test')&lt;/script&gt;", ""),
    ('<a title="x > y">z</a>', "z"), ("a < b", "a < b"), ("x<!-- no -->y", "x\ny"), ("&amp;lt;b&amp;gt;", "<b>"), (None, None)])
def test_cells_are_cleaned(spark, cell, text):
    assert one(spark, clean_html(F.lit(cell).cast("string"))) == text


def test_cleaning_leaves_other_types_and_is_stable(spark):
    df = spark.createDataFrame([(1, "<b>a</b>", date(2023, 1, 1), True)], "n int, s string, d date, b boolean")
    assert clean_strings(df).first() == (1, "a", date(2023, 1, 1), True)
    words = ["a", "b c", "\n", " ", "ü", "\n \n"]
    for _ in range(50):
        once = clean_text("".join(random.choices(words, k=9)))
        assert clean_text(once) == once


@pytest.mark.parametrize("a,b,s", [("smith", "smyth", .80), ("mcdonald", "macdonald", .941176), ("o'connor", "oconnor", .933333),
                                   ("müller", "mueller", .769231), ("hello", "hello", 1.0), ("", "", 0.0), ("hello", "", 0.0),
                                   ("ann", "anneliese", .9), ("maria lopez", "lopez maria", .95), ("maria", "maria anna lopez", .9)])
def test_similarity_values(spark, a, b, s):
    assert weighted_ratio(a, b) == pytest.approx(s, abs=1e-6)
    assert one(spark, similarity(F.lit(a), F.lit(b))) == pytest.approx(s, abs=1e-6)


def _plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_agrees_in_both_engines_and_is_symmetric(spark):
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choices("abcü' \u00a0\u2003", k=rng.randint(0, 14))).strip() for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity(F.col("a"), F.col("b")).alias("s"), similarity(F.col("b"), F.col("a")).alias("t"),
                       common_letters(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.s == pytest.approx(weighted_ratio(r.a, r.b), abs=1e-9) and r.s == pytest.approx(r.t, abs=1e-9)
        assert 0 <= r.s <= 1
        assert r.n == _plain_lcs(r.a, r.b)


@pytest.mark.parametrize("given,stored,kind,s", [
    ("Smith", "Smith", "Exact", 1.0), (" SMITH ", "smith", "Exact", 1.0), ("Smith", "Smyth", "Mismatch", .8),
    ("McDonald", "MacDonald", "Fuzzy", .941), ("O'Connor", "OConnor", "Fuzzy", .933), ("Müller", "Mueller", "Mismatch", .769),
    ("Jones", "Jackson", "Mismatch", None), ("", "x", "NotCompared", None), (None, "x", "NotCompared", None),
    ("x", None, "MissingDBValue", None), ("x", "  ", "MissingDBValue", None)])
def test_names_compare(spark, given, stored, kind, s):
    info = one(spark, compare_names("LastName", F.lit(given).cast("string"), F.lit(stored).cast("string")))
    assert info["match_type"] == kind and info["field_name"] == "LastName"
    if s:
        assert info["similarity_score"] == pytest.approx(s, abs=1e-3)
    elif kind != "Mismatch":
        assert info["similarity_score"] is None and info["details"].endswith("not provided")


@pytest.mark.parametrize("stored,kind,s,note", [
    (date(1980, 5, 15), "Exact", 1.0, None), (date(1981, 5, 15), "YearMismatch", .7, "Year diff: 1"),
    (date(1982, 5, 15), "Mismatch", 0.0, None), (date(1980, 5, 16), "Mismatch", 0.0, None),
    (date(1980, 6, 15), "Mismatch", 0.0, None), (None, "MissingDBValue", None, "DB DOB not provided"),
    (datetime(1980, 5, 15, 10), "Exact", 1.0, None)])
def test_dates_compare(spark, stored, kind, s, note):
    stored = F.lit(stored) if stored is not None else F.lit(None).cast("date")
    info = one(spark, compare_dates(F.lit(date(1980, 5, 15)), stored))
    assert (info["match_type"], info["similarity_score"], info["details"]) == (kind, s, note)


def test_leap_day_and_missing_input(spark):
    assert one(spark, compare_dates(F.lit(date(2000, 2, 29)), F.lit(date(2001, 2, 28))))["match_type"] == "Mismatch"
    assert one(spark, compare_dates(F.lit(None).cast("date"), F.lit(date(2001, 2, 28))))["match_type"] == "NotCompared"
    assert one(spark, compare_dates(F.lit(date(2000, 1, 1)), F.lit(date(2003, 1, 1)), 3))["details"] == "Year diff: 3"


def _infos(*rows):
    return {n: F.struct(F.lit(n).alias("field_name"), F.lit(k).alias("match_type"),
                        F.lit(s).cast("double").alias("similarity_score")) for n, k, s in rows}


@pytest.mark.parametrize("rows,weights,score,label", [
    ([("FirstName", "Exact", 1.0), ("LastName", "Exact", 1.0), ("DOB", "Exact", 1.0)], {}, 1.0, "Exact Match"),
    ([("FirstName", "Exact", 1.0), ("LastName", "Fuzzy", .9), ("DOB", "YearMismatch", .7)], {}, .87,
     "Partial Match: DOB:YearMismatch|FirstName:Exact|LastName:Fuzzy(0.90)"),
    ([("FirstName", "Exact", 1.0), ("LastName", "NotCompared", None)], {"FirstName": .5, "LastName": .5}, .5,
     "Partial Match: FirstName:Exact|LastName:NotCompared"),
    ([("FirstName", "Odd", 1.0)], {}, 0.0, "No Significant Match"),
    ([("FirstName", "Fuzzy", None)], {}, 0.0, "No Significant Match"),
    ([("FirstName", "MissingDBValue", None)], {}, -.03, "No Significant Match")])
def test_scores_and_labels(spark, rows, weights, score, label):
    config, infos = LinkConfig(weights=weights), _infos(*rows)
    total = overall_score(infos, config)
    got = spark.range(1).select(total.alias("s"), match_label(infos, total, config).alias("l")).first()
    assert got.s == pytest.approx(score) and got.l == label


def test_two_digits_like_printf(spark):
    values = [k / 1000 for k in range(1001)] + [0.95 * 0.9, 2 / 3, 37 / 40]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", two_digits(F.col("v")).alias("t")).collect():
        assert r.t == f"{r.v:.2f}"


@pytest.mark.parametrize("raw,clean", [("file.txt", "filetxt"), ("file name with spaces", "filenamewithspaces"),
                                       ("file<>name|with:many*special?chars", "filenamewithmanyspecialchars"), ("ü?", "")])
def test_keys_are_sanitised(spark, raw, clean):
    assert one(spark, sanitise(F.lit(raw))) == clean


def test_dates_and_ids_are_parsed(spark):
    got = [one(spark, parse_dob(F.lit(x))) for x in ("1990-12-31", "1990-1-5", "1990-02-30", "bad", "", "90-1-1")]
    assert got == [date(1990, 12, 31), date(1990, 1, 5), None, None, None, None]
    assert [one(spark, parse_id(F.lit(x))) for x in (" 12 ", "x1", "", "1.5")] == [12, None, None, None]


def test_redaction(spark):
    df = spark.createDataFrame([("password: hunter2 and token='abc' on 1980-05-15, 1/2/1999 or 3.4.2001; key = k9",)], "t string")
    assert redact(df, ["t"]).first().t == ("password=***REDACTED*** and token=***REDACTED***' on ***DATE***, ***DATE*** or ***DATE***; "
                                           "key=***REDACTED***")
    assert one(spark, redact_secrets(F.lit("nothing here"))) == "nothing here"
    assert [one(spark, mask_user(F.lit(x))) for x in ("doctor", "bob", "")] == ["do***r", "***", None]
    assert [one(spark, mask_preview(F.lit(x))) for x in ("0123456789a", "0123456789")] == ["012...89a", "0123456789"]


def test_columns_also_run_on_streams(spark, tmp_path):
    spark.createDataFrame([("<b>a</b> &amp; b", "token=1")], "h string, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("h string, t string").parquet(str(tmp_path / "in"))
    run = stream.select(clean_html("h").alias("h"), redact_secrets(F.col("t")).alias("t")).writeStream.format("memory") \
        .queryName("cleaned").option("checkpointLocation", str(tmp_path / "check")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("cleaned").collect() == [("a\n & b", "token=***REDACTED***")]
    assert html.unescape("&amp;") == "&"


def test_rounded_gives_what_round_gives(spark):
    from cohortlink.functions.compare import rounded
    values = [0.0, -1e-7, .3, .26999999999999996, .2571428571428571, 1 / 3, .1234565, .1234575, 2.5e-6, 1e10 + .1234565, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b"))
    assert all(repr(r.a) == repr(r.b) for r in df.collect())
