import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortlink import (LinkConfig, best_matches, compact_matches, flat_matches, fuzzy_link, fuzzy_search, weighted_ratio)
from cohortlink.model import PATIENT_SCHEMA
from cohortlink.operators.linkage import deciding_sets
from cohortlink.operators.names import _keyed, alike


def _names(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefg", k=rng.randint(1, 12))) for _ in range(60)]

    def name():
        words = []
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w) + 1)
                if rng.random() < .5 and w:
                    w.pop(min(i, len(w) - 1))
                else:
                    w.insert(i, rng.choice("abcdefg"))
            words.append("".join(w))
        return rng.choice([" ", "  "]).join(w for w in words if w).strip()
    return sorted({name() for _ in range(n)} - {""})


@pytest.mark.parametrize("threshold", [.7, .85, .92])
def test_alike_names_are_all_found(spark, threshold):
    left, right = _names(1, 150), _names(2, 150)
    want = {(a, b) for a in left for b in right if a == b or weighted_ratio(a, b) >= threshold}
    got = alike(*[spark.createDataFrame([("f", x) for x in xs], "field string, name string") for xs in (left, right)], threshold)
    rows = [(r.given, r.stored) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_long_names_are_found_and_have_few_keys(spark):
    rng = random.Random(9)
    def letters(n):
        return "".join(rng.choices("abcdefgh", k=n))
    left = [letters(n) for n in (24, 30, 31, 32, 33, 34, 40, 60, 90, 120)] * 4 + ["ab\u00a0" + letters(30), letters(20) + "\u2003" + letters(12)]
    right = []
    for name in left:
        word = list(name)
        for _ in range(rng.randrange(len(word) // 5)):
            at = rng.randrange(len(word))
            word[at:at + rng.randrange(2)] = letters(rng.randrange(2))
        right.append("".join(word))
        right.append(name[rng.randrange(5):len(name) // 2])
    left, right = sorted(set(left)), sorted(set(right) - {""})
    want = {(a, b) for a in left for b in right if a == b or weighted_ratio(a, b) >= .85}
    frames = [spark.createDataFrame([("f", x) for x in xs], "field string, name string") for xs in (left, right)]
    rows = [(r.given, r.stored) for r in alike(*frames, .85).collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 30
    name = spark.createDataFrame([("f", "".join(rng.choices("abcdefghijklmnop ", k=200)).strip())], "field string, name string")
    assert all(_keyed(name, .85, given).count() < 6000 for given in (True, False))


def test_alike_keeps_fields_apart_and_refuses_a_threshold_of_nothing(spark):
    a = spark.createDataFrame([("x", "anna")], "field string, name string")
    b = spark.createDataFrame([("y", "anna")], "field string, name string")
    assert alike(a, b, .85).count() == 0 and alike(a, b, .5).count() == 0
    with pytest.raises(ValueError):
        alike(a, b, 0.0)


@pytest.mark.parametrize("threshold", [.3, .5, .6, 2 / 3])
def test_low_thresholds_find_what_comparing_every_pair_finds(spark, threshold):
    """Prefix filtering on letters: every pair at or above the threshold, by brute force, on several-word names."""
    left, right = _names(3, 90), _names(4, 90) + ["ab\u00a0cd", "cd ab ab", "gfedcba gfedcba", "a"]
    want = {(a, b) for a in left for b in right if a == b or weighted_ratio(a, b) >= threshold}
    frames = [spark.createDataFrame([("f", x) for x in xs], "field string, name string") for xs in (left, right)]
    rows = [(r.given, r.stored) for r in alike(*frames, threshold).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert 0 < len(want) < len(left) * len(right)


def test_prefixes_are_few_for_rare_letters(spark):
    """Names of rare letters meet only names that hold them: candidates far below all pairs."""
    from cohortlink.operators.prefix import prefix_pairs
    common = ["".join(random.Random(i).choices("aeiou", k=8)) for i in range(60)]
    rare = ["qxz" + c[:5] for c in common[:5]]
    frame = spark.createDataFrame([("f", x) for x in sorted(set(common + rare))], "field string, name string")
    pairs = prefix_pairs(frame, frame, .6)
    rare_pairs = pairs.where(F.col("given").startswith("qxz")).collect()
    assert {r.stored for r in rare_pairs} <= set(common + rare)
    assert pairs.count() < len(set(common + rare)) ** 2


def _brute(request, person, config):
    """Score of one pair, written out for comparison; None when the person is not in the request's block."""
    first, last, dob = request
    _, p_first, p_last, p_dob = person
    if dob:
        if p_dob is None or abs(p_dob.year - dob.year) > config.year_tolerance:
            return None
    elif last:
        if not (p_last or "").startswith(last):
            return None

    def name(g, s):
        g, s = (g or "").strip().lower(), (s or "").strip().lower()
        if not g:
            return 0.0
        if not s:
            return -0.1
        if g == s:
            return 1.0
        r = weighted_ratio(g, s)
        return r if r >= config.threshold else 0.0
    day = 0.0
    if dob:
        same = (dob.month, dob.day) == (p_dob.month, p_dob.day)
        day = 1.0 if dob == p_dob else .7 if same and abs(dob.year - p_dob.year) <= config.year_tolerance else 0.0
    return name(first, p_first) * .3 + name(last, p_last) * .4 + day * .3


def _people(seed, n):
    rng = random.Random(seed)
    firsts, lasts = _names(3, 12), _names(4, 14)
    days = [date(1980 + rng.randrange(5), rng.choice([1, 2, 3]), rng.choice([1, 28])) for _ in range(9)] + [date(1980, 2, 29)]
    rows = []
    for i in range(n):
        rows.append((i, rng.choice(firsts + [None]), rng.choice(lasts + ["", None]), rng.choice(days + [None])))
    return rows


@pytest.mark.parametrize("config", [LinkConfig(), LinkConfig(min_score=.65), LinkConfig(min_score=.75),
                                    LinkConfig(min_score=.2, year_tolerance=2), LinkConfig(min_score=.5, threshold=.7)])
def test_batch_finds_what_comparing_every_pair_finds(spark, config):
    people = _people(5, 160)
    asked = [(f or "", ln or "", d) for _, f, ln, d in _people(6, 50)]
    want = {}
    for i, request in enumerate(asked, 1):
        for person in people:
            s = _brute(request, person, config)
            if s is not None and s >= config.min_score and any(request):
                want[i, person[0]] = round(s, 9)
    patients = spark.createDataFrame([(i, f, ln, d, None, None, None, None) for i, f, ln, d in people], PATIENT_SCHEMA)
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked, 1)],
                                     "row_number bigint, first_name string, last_name string, dob date")
    rows = fuzzy_link(patients, requests, config).collect()
    got = {(r.csv_input_row_number, r.PatientID): round(r.overall_score, 9) for r in rows}
    assert got == want and len(rows) == len(want)
    assert sum(1 for r in rows if len(r.match_fields_info) == 3) == len(rows)


@pytest.mark.parametrize("k,config", [(1, LinkConfig()), (3, LinkConfig()), (2, LinkConfig(min_score=.2, year_tolerance=2)),
                                      (3, LinkConfig(min_score=.5, threshold=.6))])
def test_top_k_in_rounds_equals_the_top_of_all_matches(spark, k, config):
    """The threshold algorithm gives the k best of all matches, equal scores by id, and joins fewer candidates."""
    from cohortlink.operators.linkage import fuzzy_top
    people = _people(5, 160)
    asked = [(f or "", ln or "", d) for _, f, ln, d in _people(6, 50)] + [("", "", None), (people[0][1] or "x", people[0][2] or "y", people[0][3])] * 2
    want = {}
    for i, request in enumerate(asked, 1):
        scores = sorted(((-round(s, 9), person[0]) for person in people
                         if (s := _brute(request, person, config)) is not None and s >= config.min_score and any(request)))
        for rank, (s, pid) in enumerate(scores[:k], 1):
            want[i, rank] = (pid, -s)
    patients = spark.createDataFrame([(i, f, ln, d, None, None, None, None) for i, f, ln, d in people], PATIENT_SCHEMA)
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked, 1)],
                                     "row_number bigint, first_name string, last_name string, dob date")
    rounds = []
    rows = fuzzy_top(patients, requests, k, config, rounds=rounds).collect()
    got = {(r.csv_input_row_number, r.rank): (r.PatientID, round(r.overall_score, 9)) for r in rows}
    assert got == want
    every = best_matches(fuzzy_link(patients, requests, config), k).collect()
    assert sorted((r.csv_input_row_number, r.rank, r.PatientID) for r in every) == sorted((r.csv_input_row_number, r.rank, r.PatientID) for r in rows)
    assert rounds and all(len(r) == 4 for r in rounds)


def test_top_k_of_common_names_joins_a_few_people_of_each(spark):
    """Repeated requests go as one, and of people alike in all that is compared only k (2 k a year) are joined."""
    from cohortlink.operators.linkage import fuzzy_top
    people = [(i, "Anna", "Schmidt", date(1980 + i % 3, 1 + i % 2, 1 + i % 2)) for i in range(120)]
    people += [(200 + i, "Anna", "Schmidt", date(1980, 3, 1 + i % 28)) for i in range(60)]
    patients = spark.createDataFrame([(i, f, ln, d, None, None, None, None) for i, f, ln, d in reversed(people)], PATIENT_SCHEMA)
    asked = [("Anna", "Schmidt", date(1981, 1, 1)), ("Anna", "Schmidt", None), ("Anna", "", date(1980, 3, 2)), ("", "Schmidt", date(1979, 2, 2)),
             ("Anna", "Schmitt", date(1981, 5, 5)), ("Anna", "", None)] * 20
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "row_number bigint, first_name string, last_name string, dob date")
    for k in (1, 4):
        rounds = []
        top = fuzzy_top(patients, requests, k, rounds=rounds).collect()
        every = best_matches(fuzzy_link(patients, requests), k).collect()
        assert sorted((r.csv_input_row_number, r.rank, r.PatientID, round(r.overall_score, 9)) for r in top) \
            == sorted((r.csv_input_row_number, r.rank, r.PatientID, round(r.overall_score, 9)) for r in every)
        # All matches of these 120 requests are some 18 000 pairs.
        assert sum(pairs for _, _, pairs, _ in rounds) < 1200 and max(n for *_, n in rounds) <= 4


def test_lists_of_requests_meet_parts_of_large_groups_and_every_pair_comes_once(spark, monkeypatch):
    """Groups larger than a list and a part; each match shows its own request, and pairs of rows are not joined again."""
    from cohortlink.operators import linkage
    monkeypatch.setattr(linkage, "LIST", 3)
    monkeypatch.setattr(linkage, "MEET", 2)
    people = [(i, "Anna", "Schmidt", date(1980 + i % 2, 1 + i % 3, 1)) for i in range(24)]
    asked = [(["Anna", "ANNA ", " anna"][i % 3], ["Schmitt", "Schmidt "][i % 2], [date(1980, 1 + i % 4, 1), None][i % 9 == 8]) for i in range(18)]
    asked += [("", "", date(1981, 2, 1)), ("Anna", "", None)]
    patients = spark.createDataFrame([(i, f, ln, d, None, None, None, None) for i, f, ln, d in people], PATIENT_SCHEMA)
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "row_number bigint, first_name string, last_name string, dob date")
    found = fuzzy_link(patients, requests)
    rows = found.collect()
    want = {(i, p[0]): round(s, 9) for i, r in enumerate(asked) for p in people if (s := _brute(r, p, LinkConfig())) is not None and s >= .3}
    assert {(r.csv_input_row_number, r.PatientID): round(r.overall_score, 9) for r in rows} == want and len(rows) == len(want) > 300
    for r in rows:
        assert tuple(i.input_value or "" for i in r.match_fields_info) == tuple(str(x or "") for x in asked[r.csv_input_row_number])
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("csv_input_row_number" in line for line in joins)


def test_a_low_score_pairs_groups_of_names_not_rows(spark, monkeypatch):
    """Nearly every name is alike and a date alone is enough: the same matches as comparing every pair, without joins of rows."""
    from cohortlink.operators import linkage
    monkeypatch.setattr(linkage, "LIST", 2)
    monkeypatch.setattr(linkage, "MEET", 3)
    config = LinkConfig(threshold=.6, min_score=.05)
    people, asked = _people(5, 40) * 2, [(f or "", ln or "", d) for _, f, ln, d in _people(6, 15)] * 2
    people = [(i, *p[1:]) for i, p in enumerate(people)]
    patients = spark.createDataFrame([(i, f, ln, d, None, None, None, None) for i, f, ln, d in people], PATIENT_SCHEMA)
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "row_number bigint, first_name string, last_name string, dob date")
    found = fuzzy_link(patients, requests, config)
    rows = found.collect()
    want = {(i, p[0]): round(s, 9) for i, r in enumerate(asked) if any(r) for p in people if (s := _brute(r, p, config)) is not None and s >= .05}
    assert {(r.csv_input_row_number, r.PatientID): round(r.overall_score, 9) for r in rows} == want and len(rows) == len(want)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("csv_input_row_number" in line for line in joins)


def test_one_search_finds_what_a_batch_finds(spark):
    people = _people(5, 120)
    patients = spark.createDataFrame([(i, f, ln, d, None, None, None, None) for i, f, ln, d in people], PATIENT_SCHEMA)
    for first, last, dob in [(people[0][1], people[1][2], date(1981, 2, 28)), (None, people[2][2], None), (people[3][1], None, None)]:
        found = fuzzy_search(patients, first, last, dob).collect()
        scores = [r.overall_score for r in found]
        assert scores == sorted(scores, reverse=True)
        want = {p[0] for p in people if (_brute((first, last, dob), p, LinkConfig()) or 0) >= .3}
        assert {r.PatientID for r in found} == want


def test_search_wildcards_case_and_limits(spark, patients, diagnoses):
    assert [r.PatientID for r in fuzzy_search(patients, last_name="M_ller", config=LinkConfig(min_score=0.0)).collect()] == [1001]
    assert fuzzy_search(patients, "Hans", "müller").count() == 0
    assert fuzzy_search(patients, "Hans", "müller", config=LinkConfig(ignore_case=True)).count() == 1
    wide = fuzzy_search(patients, "Hans", "Muller", date(1980, 5, 15), diagnoses=diagnoses)
    assert sorted(r.ICD10 for r in wide.collect()) == ["E11.9", "I10"]
    with pytest.raises(ValueError):
        fuzzy_search(patients)
    requests = spark.createDataFrame([(1, "Hans", "M_ller", None)], "row_number bigint, first_name string, last_name string, dob date")
    assert [r.PatientID for r in fuzzy_link(patients, requests).collect()] == [1001]
    with pytest.raises(ValueError):
        fuzzy_link(patients, requests, LinkConfig(min_score=0.0))


def test_shapes_of_matches(spark, patients):
    requests = spark.createDataFrame([(1, "Hans", "Mueller", date(1980, 5, 15)), (2, "Hans", "", date(1981, 5, 15))],
                                     "row_number bigint, first_name string, last_name string, dob date")
    found = fuzzy_link(patients, requests)
    flat = flat_matches(found)
    assert {f"{n}_{p}" for n in ("FirstName", "LastName", "DOB")
            for p in ("input_value", "db_value", "match_type", "similarity", "details")} <= set(flat.columns)
    by = {r.csv_input_row_number: r for r in flat.collect()}
    assert by[1].LastName_match_type == "Mismatch" and by[2].LastName_details == "Input name not provided"
    assert by[2].primary_match_type == "Partial Match: DOB:YearMismatch|FirstName:Exact|LastName:NotCompared"
    assert compact_matches(found).columns == ["Name", "DOB", "Score", "Match Type"]
    assert [r["rank"] for r in best_matches(found, 1).collect()] == [1, 1]


def test_deciding_sets():
    fields = ["FirstName", "LastName", "DOB"]
    assert deciding_sets(LinkConfig(), fields) == [("FirstName",), ("LastName",), ("DOB",)]
    assert deciding_sets(LinkConfig(min_score=.65), fields) == [("FirstName", "LastName"), ("LastName", "DOB")]
    assert deciding_sets(LinkConfig(min_score=.75), fields) == [("FirstName", "LastName", "DOB")]
    assert deciding_sets(LinkConfig(min_score=0.0), fields) == [()]
    with pytest.raises(ValueError):
        LinkConfig(threshold=1.1)


def test_no_cross_join_and_no_python_in_the_main_join(spark, patients):
    requests = spark.createDataFrame([(1, "Hans", "Mueller", date(1980, 5, 15))],
                                     "row_number bigint, first_name string, last_name string, dob date")
    plan = fuzzy_link(patients, requests)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
