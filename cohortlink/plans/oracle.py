"""The registered queries once more, as SQL over the same tables for comparison in another engine."""

from __future__ import annotations

PATIENTS = """patients AS (
  SELECT p_partkey AS "PatientID", split_part(p_name, ' ', 1) AS "Vorname", split_part(p_name, ' ', 2) AS "Name",
         CAST(DATE '1950-01-01' + CAST(p_partkey * 7919 % 20000 AS INTEGER) AS DATE) AS "Geburtsdatum",
         p_brand AS "Grunderkrankung", CAST(NULL AS VARCHAR) AS "ET_Grunderkrankung", p_type AS "Dauernotiz",
         CAST(NULL AS VARCHAR) AS "Dauernotiz_Diagnose" FROM part)"""

DIAGNOSES = """diagnoses AS (
  SELECT l_partkey AS "PatientID", l_returnflag || '.' || l_linenumber AS "ICD10", l_linestatus AS "Bezeichnung",
         CAST(l_shipdate AS DATE) AS "Date" FROM lineitem)"""

CONTACTS = 'contacts AS (SELECT c_custkey AS "PatientID", c_name AS "Name", c_mktsegment AS "Segment" FROM customer)'

IDS = """ids AS (
  SELECT row_number, raw_id, TRY_CAST(raw_id AS BIGINT) AS id FROM (
    SELECT o_orderkey + 1 AS row_number, trim(CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_custkey
      WHEN o_orderkey % 11 = 0 THEN '  ' ELSE ' ' || (o_custkey * 2) END) AS raw_id FROM orders)
  WHERE raw_id <> '')"""

REQUESTS = """asked AS (
  SELECT "PatientID" + 1 AS row_number, CASE WHEN "PatientID" % 11 = 3 THEN '' ELSE "Vorname" END AS first_name,
    CASE WHEN "PatientID" % 3 = 0 THEN substr("Name", 1, 1) || substr("Name", 3) ELSE "Name" END AS last_name,
    CASE WHEN "PatientID" % 13 = 3 THEN 'bad' WHEN "PatientID" % 17 = 5 THEN ''
      WHEN "PatientID" % 7 = 0 THEN CAST(CAST("Geburtsdatum" + INTERVAL 1 YEAR AS DATE) AS VARCHAR)
      ELSE CAST("Geburtsdatum" AS VARCHAR) END AS dob_raw FROM patients),
requests AS (
  SELECT *, TRY_CAST(CASE WHEN regexp_matches(dob_raw, '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN dob_raw END AS DATE) AS dob,
    CAST(json_object('FirstName', first_name, 'LastName', last_name, 'DOB', dob_raw) AS VARCHAR) AS raw FROM asked)"""

CHECKED = """checked AS (
  SELECT *, CASE WHEN first_name = '' OR last_name = '' THEN 'Missing first name or last name'
    WHEN dob_raw <> '' AND dob IS NULL THEN 'Invalid DOB format: ' || dob_raw
    WHEN dob IS NULL THEN 'DOB is required for exact match' END AS reason FROM requests)"""

OUTCOMES = """outcomes AS (
  SELECT row_number, CASE WHEN reason IS NULL AND NOT EXISTS (SELECT 1 FROM patients p WHERE p."Vorname" = first_name
      AND p."Name" = last_name AND p."Geburtsdatum" = dob) THEN 'No matching patient found' ELSE reason END AS reason
  FROM checked)"""

PATIENT = """p."PatientID", p."Vorname", p."Name", CAST(p."Geburtsdatum" AS VARCHAR) AS "Geburtsdatum",
  p."Grunderkrankung", p."ET_Grunderkrankung", p."Dauernotiz", p."Dauernotiz_Diagnose\""""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, one bit per letter of ``a``."""
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = (f"CAST(coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: "
            f"CASE WHEN substr({a}, i, 1) = ch THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END)), 0) AS BIGINT)")
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    step = f"lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), {step})))"


def _similarity(a: str, b: str) -> str:
    """Weighted similarity of two names of one word each, held in columns ``a`` and ``b``."""
    base = f"2.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b}))"
    short = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END"
    long = f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    windows = ("list_transform(range(1 - length(short), length(long)), lambda k: substr(long, greatest(k, 0) + 1, "
               "length(short) + least(k, 0)))")
    best = f"list_max(list_transform({windows}, lambda w: 2.0::DOUBLE * {_lcs('short', 'w')} / (length(short) + length(w))))"
    spread = "length(long)::DOUBLE / length(short)"
    return f"""SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN {spread} < 1.5 THEN {base}
      ELSE greatest({base}, {best} * CASE WHEN {spread} <= 8 THEN 0.9 ELSE 0.6 END) END AS s
    FROM (SELECT *, {short} AS short, {long} AS long FROM pairs_in)"""


def _sims(pairs: str, name: str = "sims") -> str:
    """Table ``sims(a, b, s)`` for the distinct pairs of a query."""
    return f"""pairs_in AS (SELECT DISTINCT a, b FROM ({pairs})), {name} AS (SELECT a, b, s FROM ({_similarity('a', 'b')}))"""


def _scored(block: str, least: float, threshold: float = 0.85) -> str:
    """Tables ``scored``: pairs of ``block(row_number, raw, fi, la, dob, and the person's columns)`` with their score."""
    pairs = 'SELECT lower(trim(fi)) AS a, lower("Vorname") AS b FROM block UNION ALL SELECT lower(trim(la)), lower("Name") FROM block'

    def kind(a, b, s):
        return (f"CASE WHEN coalesce(trim({a}), '') = '' THEN 'NotCompared' WHEN coalesce({b}, '') = '' THEN 'MissingDBValue' "
                f"WHEN lower(trim({a})) = lower({b}) THEN 'Exact' WHEN {s} >= {threshold} THEN 'Fuzzy' ELSE 'Mismatch' END")
    shifted = 'month(dob) = month("Geburtsdatum") AND day(dob) = day("Geburtsdatum") AND abs(year(dob) - year("Geburtsdatum")) = 1'

    def points(t, s):
        return f"CASE {t} WHEN 'Exact' THEN 1.0 WHEN 'Fuzzy' THEN {s} WHEN 'YearMismatch' THEN 0.7 WHEN 'MissingDBValue' THEN -0.1 ELSE 0.0 END"

    def part(n, t, s):
        return f"'{n}:' || {t} || CASE WHEN {t} = 'Fuzzy' THEN printf('(%.2f)', {s}) ELSE '' END"
    return f"""block AS ({block}), {_sims(pairs)},
    typed AS (SELECT block.*, CASE WHEN coalesce(trim(fi), '') <> '' THEN x.s END AS fs, CASE WHEN coalesce(trim(la), '') <> '' THEN y.s END AS ls,
        {kind('fi', '"Vorname"', 'x.s')} AS ft, {kind('la', '"Name"', 'y.s')} AS lt,
        CASE WHEN dob IS NULL THEN 'NotCompared' WHEN "Geburtsdatum" IS NULL THEN 'MissingDBValue' WHEN dob = "Geburtsdatum" THEN 'Exact'
          WHEN {shifted} THEN 'YearMismatch' ELSE 'Mismatch' END AS dt
      FROM block LEFT JOIN sims x ON x.a = lower(trim(fi)) AND x.b = lower("Vorname") LEFT JOIN sims y ON y.a = lower(trim(la)) AND y.b = lower("Name")),
    valued AS (SELECT *, CASE dt WHEN 'Exact' THEN 1.0::DOUBLE WHEN 'YearMismatch' THEN 0.7::DOUBLE WHEN 'Mismatch' THEN 0.0::DOUBLE END AS ds,
        ({points('ft', 'fs')})::DOUBLE * 0.3::DOUBLE + ({points('lt', 'ls')})::DOUBLE * 0.4::DOUBLE + ({points('dt', '0.0')})::DOUBLE * 0.3::DOUBLE AS score FROM typed),
    scored AS (SELECT *, round(score, 6) AS overall_score, CASE WHEN ft = 'Exact' AND lt = 'Exact' AND dt = 'Exact' THEN 'Exact Match'
        WHEN score > 0.01 THEN 'Partial Match: ' || ('DOB:' || dt) || '|' || ({part('FirstName', 'ft', 'fs')}) || '|' || ({part('LastName', 'lt', 'ls')})
        ELSE 'No Significant Match' END AS primary_match_type FROM valued WHERE score >= {least})"""


def _search(first: str, last: str, dob: str, where: str, least: float = 0.3) -> str:
    block = f'SELECT {first} AS fi, {last} AS la, {dob} AS dob, * FROM patients WHERE {where}'
    return _with(PATIENTS, _scored(block, least)) + 'SELECT "PatientID", overall_score, primary_match_type FROM scored'


_BATCH = _with(PATIENTS, DIAGNOSES, REQUESTS, _scored("""
  SELECT r.row_number, r.raw, r.first_name AS fi, r.last_name AS la, r.dob, p.* FROM requests r, patients p
  WHERE CASE WHEN r.dob IS NOT NULL THEN year(p."Geburtsdatum") BETWEEN year(r.dob) - 1 AND year(r.dob) + 1
    WHEN r.last_name <> '' THEN starts_with(p."Name", r.last_name) ELSE TRUE END""", 0.75))

_VARIED = f"""asked_for AS (SELECT * REPLACE (CASE WHEN row_number % 23 = 5 THEN '' ELSE last_name END AS last_name) FROM requests),
  known AS (SELECT * REPLACE (CASE WHEN "PatientID" % 19 <> 4 THEN "Name" END AS "Name") FROM patients),
  judged AS (SELECT *, CASE WHEN first_name = '' AND last_name = '' AND dob_raw = '' THEN 'At least one search parameter is required for fuzzy search'
    WHEN dob_raw <> '' AND dob IS NULL THEN 'Invalid DOB format: ' || dob_raw END AS reason FROM asked_for)"""


def _varied(least: float, threshold: float = 0.85) -> str:
    return _with(PATIENTS, DIAGNOSES, REQUESTS, _VARIED, _scored("""
  SELECT r.row_number, r.raw, r.first_name AS fi, r.last_name AS la, r.dob, p.* FROM judged r, known p
  WHERE r.reason IS NULL AND CASE WHEN r.dob IS NOT NULL THEN year(p."Geburtsdatum") BETWEEN year(r.dob) - 1 AND year(r.dob) + 1
    WHEN r.last_name <> '' THEN starts_with(p."Name", r.last_name) ELSE TRUE END""", least, threshold))


_LINK = """SELECT i.row_number, p."PatientID", p."Vorname", p."Name", d."PatientID" AS "diagnoses_PatientID", d."ICD10",
  d."Bezeichnung", CAST(d."Date" AS VARCHAR) AS "Date", c."Name" AS "contacts_Name", c."Segment"
  FROM patients p {how} JOIN diagnoses d ON p."PatientID" = d."PatientID" {how} JOIN contacts c ON p."PatientID" = c."PatientID"
  JOIN ids i ON p."PatientID" = i.id"""

_RECORDS = """records AS (
  SELECT p."PatientID", p."Vorname", p."Name", p."Geburtsdatum", p."Dauernotiz", d."ICD10", d."Bezeichnung", d."Date"
  FROM patients p LEFT JOIN diagnoses d USING ("PatientID"))"""

_REPORTS = _with(PATIENTS, DIAGNOSES, _RECORDS)

_IN_ORDER = '"Date" NULLS FIRST, "ICD10" NULLS FIRST, "Bezeichnung" NULLS FIRST'

_INFO = """'{"patient_info":{"Name":"' || "Name" || '","Vorname":"' || "Vorname" || '","PatientID":' || "PatientID"
  || ',"Geburtsdatum":"' || CAST("Geburtsdatum" AS VARCHAR) || '"},'"""


def _quoted(c: str) -> str:
    return f"""coalesce('"' || {c} || '"', 'null')"""


_LINES = " UNION ALL ".join(
    f'SELECT "PatientID", {i} AS pos, trim("{c}") AS line FROM patients WHERE trim("{c}") <> \'\''
    for i, c in enumerate(["Vorname", "Name", None, "Grunderkrankung", "ET_Grunderkrankung", "Dauernotiz", "Dauernotiz_Diagnose"])
    if c)

_SECTIONS = " UNION ALL ".join(
    [f"""SELECT DISTINCT "PatientID", 'Patient' AS section, CAST(NULL AS VARCHAR) AS "order_Date", CAST(NULL AS VARCHAR) AS "order_ICD10",
      CAST(NULL AS VARCHAR) AS "order_Bezeichnung", CAST({i} AS INTEGER) AS seq, '{c}' AS field, CAST("{c}" AS VARCHAR) AS value FROM records"""
     for i, c in enumerate(["Name", "Vorname", "PatientID", "Geburtsdatum"])]
    + [f"""SELECT "PatientID", 'Diagnoses', CAST("Date" AS VARCHAR), "ICD10", "Bezeichnung", {i}, '{c}', coalesce(CAST("{c}" AS VARCHAR), '') FROM records
      {'' if c in ('ICD10', 'Bezeichnung') else f'WHERE "{c}" IS NOT NULL'}"""
       for i, c in enumerate(["Bezeichnung", "Date", "Dauernotiz", "ICD10"])])

# Whitespace as the cleaning sees it, and the characters the pages hold as references.
_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PAGE_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "''", "copy": "©", "middot": "·", "amp": "&"}


def _unescaped(c: str) -> str:
    for name, text in _PAGE_REFERENCES.items():
        c = f"replace({c}, '&{name};', '{text}')"
    return c


def _cleaned(c: str) -> str:
    hidden = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style")) + r"|<!--.*?(?:-->|\z)|<![^>]*>"
    c = rf"regexp_replace({_unescaped(c)}, '<br\s*/?>', chr(10), 'gi')"
    c = f"regexp_replace({c}, '{hidden}', chr(10), 'gis')"
    c = f"regexp_replace({c}, '</?[a-zA-Z][^>]*>', chr(10), 'g')"
    c = rf"regexp_replace({_unescaped(c)}, '\n{_SPACE}*\n+', chr(10), 'g')"
    return rf"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+\z', '', 'g')"


_DATE_TEXT = """'on ' || strftime(o_orderdate, '%Y-%m-%d') || ', by ' || strftime(o_orderdate, '%-m/%-d/%Y') || ' or '
  || strftime(o_orderdate, '%d.%m.%Y') || '; no. ' || o_orderkey"""


def _dates_hidden(c: str) -> str:
    for pattern in (r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"):
        c = f"regexp_replace({c}, '{pattern}', '***DATE***', 'g')"
    return c


def _preview(c: str) -> str:
    return f"CASE WHEN length({c}) > 10 THEN left({c}, 3) || '...' || right({c}, 3) ELSE {c} END"


_FLAT = ", ".join(
    f'{given} AS "{n}_input_value", {stored} AS "{n}_db_value", {t} AS "{n}_match_type", round({s}, 6) AS "{n}_similarity", {d} AS "{n}_details"'
    for n, given, stored, t, s, d in (
        ("FirstName", "fi", '"Vorname"', "ft", "fs", "CASE WHEN fi = '' THEN 'Input name not provided' END"),
        ("LastName", "la", '"Name"', "lt", "ls", "CASE WHEN la = '' THEN 'Input name not provided' END"),
        ("DOB", "CAST(dob AS VARCHAR)", 'CAST("Geburtsdatum" AS VARCHAR)', "dt", "ds",
         "CASE WHEN dt = 'NotCompared' THEN 'Input DOB not provided' WHEN dt = 'YearMismatch' THEN 'Year diff: 1' END")))

_DETAIL = " UNION ALL ".join(
    f'SELECT row_number AS csv_input_row_number, "PatientID", \'{n}\' AS field_name, {given} AS input_value, {stored} AS db_value, {t} AS match_type FROM scored'
    for n, given, stored, t in (("FirstName", "fi", '"Vorname"', "ft"), ("LastName", "la", '"Name"', "lt"),
                                ("DOB", "CAST(dob AS VARCHAR)", 'CAST("Geburtsdatum" AS VARCHAR)', "dt")))

_PAIRED = f"""paired AS (SELECT r.*, p."PatientID", p."Vorname", p."Name", p."Geburtsdatum" FROM requests r JOIN patients p ON r.row_number = p."PatientID" + 1)"""

_KEY = """regexp_replace("Vorname" || '_' || "Name" || '/' || CAST("Geburtsdatum" AS VARCHAR), '[^A-Za-z0-9_-]', '', 'g')"""

ORACLE: dict[str, str] = {
    "q_scan": _with(PATIENTS) + f"SELECT {PATIENT} FROM patients p",
    "q_lookup_id": _with(PATIENTS, DIAGNOSES) + f"""SELECT {PATIENT}, d."ICD10", d."Bezeichnung" AS "DiagnoseBezeichnung"
        FROM patients p LEFT JOIN diagnoses d USING ("PatientID") WHERE p."PatientID" = 42""",
    "q_lookup_demo": _with(PATIENTS) + f"""SELECT {PATIENT} FROM patients p
        WHERE "Vorname" = 'small' AND "Name" = 'ring' AND p."Geburtsdatum" = DATE '1950-01-01'""",
    "q_lastname_like": _with(PATIENTS) + f"""SELECT {PATIENT} FROM patients p WHERE "Name" LIKE 'wi%'""",
    "q_dob_year_range": _with(PATIENTS) + f"""SELECT {PATIENT} FROM patients p WHERE year(p."Geburtsdatum") BETWEEN 1970 AND 1979""",
    "q_template": _with(PATIENTS, DIAGNOSES) + """SELECT p."PatientID", p."Name", CAST(p."Geburtsdatum" AS VARCHAR) AS "Geburtsdatum", d."ICD10"
        FROM patients p LEFT JOIN diagnoses d ON p."PatientID" = d."PatientID" AND d."Bezeichnung" = 'F'
        WHERE p."Geburtsdatum" BETWEEN DATE '1960-01-01' AND DATE '1989-12-31' AND p."Name" = 'ring' AND p."Vorname" IN ('red', 'old')""",
    "q_patient_diag": _with(PATIENTS, DIAGNOSES) + f"""SELECT {PATIENT}, d."ICD10", d."Bezeichnung" AS "DiagnoseBezeichnung"
        FROM patients p LEFT JOIN diagnoses d USING ("PatientID")""",
    **{f"q_link_{how.lower()}": _with(PATIENTS, DIAGNOSES, CONTACTS, IDS) + _LINK.format(how=how)
       for how in ("LEFT", "INNER", "RIGHT", "FULL")},
    "q_link_where": _with(PATIENTS, DIAGNOSES, CONTACTS) + """SELECT p."PatientID", p."Vorname", p."Name", d."PatientID" AS "diagnoses_PatientID",
        d."ICD10", d."Bezeichnung", CAST(d."Date" AS VARCHAR) AS "Date", c."Name" AS "contacts_Name", c."Segment"
        FROM patients p JOIN diagnoses d USING ("PatientID") JOIN contacts c USING ("PatientID")
        WHERE d."ICD10" LIKE 'A%' AND d."Date" >= DATE '1998-01-01'""",
    "q_topn": _with(PATIENTS, DIAGNOSES, CONTACTS) + """SELECT p."PatientID", p."Vorname", p."Name", d."PatientID" AS "diagnoses_PatientID",
        d."ICD10", d."Bezeichnung", CAST(d."Date" AS VARCHAR) AS "Date", c."Name" AS "contacts_Name", c."Segment"
        FROM patients p JOIN diagnoses d USING ("PatientID") JOIN contacts c USING ("PatientID")
        ORDER BY d."Date" DESC, p."PatientID", d."ICD10", d."Bezeichnung" LIMIT 100""",
    "q_link_limit_per_id": _with(PATIENTS, DIAGNOSES, IDS) + """SELECT i.row_number, p."PatientID", p."Vorname", p."Name",
        d."PatientID" AS "diagnoses_PatientID", d."ICD10", d."Bezeichnung", CAST(d."Date" AS VARCHAR) AS "Date"
        FROM ids i JOIN patients p ON p."PatientID" = i.id LEFT JOIN diagnoses d ON p."PatientID" = d."PatientID"
        QUALIFY row_number() OVER (PARTITION BY i.row_number ORDER BY d."Date" DESC NULLS LAST, d."ICD10", d."Bezeichnung") <= 3""",
    "q_batch_ids": _with(PATIENTS, DIAGNOSES, IDS) + f"""SELECT i.row_number, {PATIENT}, d."ICD10", d."Bezeichnung" AS "DiagnoseBezeichnung"
        FROM ids i JOIN patients p ON p."PatientID" = i.id LEFT JOIN diagnoses d ON p."PatientID" = d."PatientID\"""",
    "q_batch_ids_summary": _with(IDS) + """SELECT count(*) AS total, count(id) AS processed,
        count(DISTINCT CASE WHEN id IS NULL THEN raw_id END) AS failed FROM ids""",
    "q_batch_ids_failed": _with(IDS) + "SELECT DISTINCT raw_id, 'Invalid ID format' AS reason FROM ids WHERE id IS NULL",
    "q_batch_demo": _with(PATIENTS, REQUESTS, CHECKED) + f"""SELECT c.row_number, c.raw, {PATIENT} FROM checked c JOIN patients p
        ON p."Vorname" = c.first_name AND p."Name" = c.last_name AND p."Geburtsdatum" = c.dob WHERE c.reason IS NULL""",
    "q_batch_demo_outcome": _with(PATIENTS, REQUESTS, CHECKED, OUTCOMES) + "SELECT row_number, reason FROM outcomes",
    "q_batch_demo_misses": _with(PATIENTS, REQUESTS, CHECKED, OUTCOMES) + """SELECT row_number, r.dob_raw FROM outcomes JOIN requests r USING (row_number)
        WHERE reason = 'No matching patient found'""",
    "q_batch_demo_summary": _with(PATIENTS, REQUESTS, CHECKED, OUTCOMES) + """SELECT count(*) AS total, count_if(reason IS NULL)::BIGINT AS processed,
        count_if(reason IS NOT NULL)::BIGINT AS failed FROM outcomes""",
    "q_similarity": _with(PATIENTS, REQUESTS, _PAIRED, _sims(
        'SELECT last_name AS a, "Name" AS b FROM paired UNION ALL SELECT "Vorname", "Name" FROM paired')) + """
        SELECT row_number, round(x.s, 6) AS last_names, round(y.s, 6) AS first_and_last FROM paired
        JOIN sims x ON x.a = last_name AND x.b = "Name" JOIN sims y ON y.a = "Vorname" AND y.b = "Name\"""",
    "q_compare_names": _with(PATIENTS, REQUESTS, _PAIRED, _sims('SELECT last_name AS a, "Name" AS b FROM paired')) + """
        SELECT row_number, 'LastName' AS field_name, last_name AS input_value, "Name" AS db_value,
          CASE WHEN last_name = "Name" THEN 'Exact' WHEN s >= 0.85 THEN 'Fuzzy' ELSE 'Mismatch' END AS match_type,
          round(s, 6) AS similarity_score, CAST(NULL AS VARCHAR) AS details FROM paired JOIN sims ON a = last_name AND b = "Name\"""",
    "q_compare_dates": _with(PATIENTS, REQUESTS, _PAIRED) + """SELECT row_number, field_name, input_value, db_value, match_type,
        CASE match_type WHEN 'Exact' THEN 1.0::DOUBLE WHEN 'YearMismatch' THEN 0.7::DOUBLE WHEN 'Mismatch' THEN 0.0::DOUBLE END AS similarity_score,
        CASE match_type WHEN 'NotCompared' THEN 'Input DOB not provided' WHEN 'YearMismatch' THEN 'Year diff: 1' END AS details
        FROM (SELECT row_number, 'DOB' AS field_name, CAST(dob AS VARCHAR) AS input_value, CAST("Geburtsdatum" AS VARCHAR) AS db_value,
          CASE WHEN dob IS NULL THEN 'NotCompared' WHEN dob = "Geburtsdatum" THEN 'Exact' WHEN month(dob) = month("Geburtsdatum")
            AND day(dob) = day("Geburtsdatum") AND abs(year(dob) - year("Geburtsdatum")) = 1 THEN 'YearMismatch' ELSE 'Mismatch' END AS match_type
          FROM paired)""",
    "q_fuzzy_one": _search("'red'", "'widgt'", "DATE '1975-06-15'", 'year("Geburtsdatum") BETWEEN 1974 AND 1976'),
    "q_fuzzy_one_name": _search("'old'", "'pla'", "CAST(NULL AS DATE)", "\"Name\" LIKE 'pla%'"),
    "q_fuzzy_one_any": _search("'smal'", "CAST(NULL AS VARCHAR)", "CAST(NULL AS DATE)", "TRUE", 0.0),
    "q_fuzzy_batch": _BATCH + 'SELECT row_number AS csv_input_row_number, raw AS csv_input_data, "PatientID", overall_score, primary_match_type FROM scored',
    "q_fuzzy_top1": _BATCH + """SELECT csv_input_row_number, "PatientID", overall_score, rank FROM (SELECT row_number AS csv_input_row_number, "PatientID", overall_score,
        CAST(row_number() OVER (PARTITION BY row_number ORDER BY overall_score DESC, "PatientID") AS INTEGER) AS rank FROM scored) WHERE rank = 1""",
    "q_fuzzy_diag": _BATCH + """SELECT row_number AS csv_input_row_number, s."PatientID", overall_score, d."ICD10", d."Bezeichnung" AS "DiagnoseBezeichnung"
        FROM scored s LEFT JOIN diagnoses d ON s."PatientID" = d."PatientID\"""",
    "q_fuzzy_flat": _BATCH + f"""SELECT overall_score, primary_match_type, row_number AS csv_input_row_number, {PATIENT}, {_FLAT} FROM scored p""",
    "q_fuzzy_detail": _BATCH + _DETAIL,
    "q_fuzzy_compact": _BATCH + """SELECT "Name", CAST("Geburtsdatum" AS VARCHAR) AS "DOB", overall_score AS "Score", primary_match_type AS "Match Type" FROM scored""",
    "q_fuzzy_default": _varied(0.3) + 'SELECT row_number AS csv_input_row_number, "PatientID", overall_score, primary_match_type FROM scored',
    "q_fuzzy_default_top3": _varied(0.3) + """SELECT csv_input_row_number, "PatientID", overall_score, rank FROM (SELECT row_number AS csv_input_row_number, "PatientID", overall_score,
        CAST(row_number() OVER (PARTITION BY row_number ORDER BY overall_score DESC, "PatientID") AS INTEGER) AS rank FROM scored) WHERE rank <= 3""",
    "q_fuzzy_low": _varied(0.05, 0.6) + 'SELECT row_number AS csv_input_row_number, "PatientID", overall_score, primary_match_type FROM scored',
    "q_fuzzy_outcome": _varied(0.75) + """SELECT row_number, coalesce(reason, CASE WHEN row_number NOT IN (SELECT row_number FROM scored)
        THEN 'No matching patient found' END) AS reason FROM judged""",
    "q_html_clean": f"SELECT page_id, {_cleaned('html')} AS text FROM pages",
    "q_redact_secrets": r"""SELECT doc_id, regexp_replace(text, '(?i)(password|pwd|secret|token|key)[''"]?\s*[:=]\s*[''"]?[^\s''"]+',
        '\1=***REDACTED***', 'g') AS text FROM documents""",
    "q_redact_dates": f"SELECT o_orderkey, {_dates_hidden(_DATE_TEXT)} AS text FROM orders",
    "q_mask_user": """SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN left(c_name, 2) || '***' || right(c_name, 1)
        WHEN length(c_name) > 0 THEN '***' END AS masked FROM customer""",
    "q_mask_preview": f"SELECT c_custkey, {_preview('c_name')} AS name, {_preview('c_mktsegment')} AS segment FROM customer",
    "q_distinct_patients": _with(PATIENTS) + 'SELECT count(*) AS people FROM (SELECT DISTINCT "Name", "Vorname" FROM patients)',
    "q_group_report": _REPORTS + f"""SELECT "PatientID", count(*) AS n_records, any_value("Name") AS "Name", any_value("Vorname") AS "Vorname",
        string_agg(concat_ws('|', CAST("Date" AS VARCHAR), "ICD10"), ';' ORDER BY {_IN_ORDER}) AS codes FROM records GROUP BY "PatientID\"""",
    "q_group_runs": _with(PATIENTS, IDS) + """, found AS (SELECT i.row_number, p.* FROM ids i JOIN patients p ON p."PatientID" = i.id),
        marked AS (SELECT *, CASE WHEN ("Name", "Vorname") IS DISTINCT FROM lag(("Name", "Vorname")) OVER (ORDER BY row_number) THEN 1 ELSE 0 END AS opens FROM found),
        counted AS (SELECT *, CAST(sum(opens) OVER (ORDER BY row_number) AS BIGINT) AS run FROM marked)
        SELECT run, count(*) AS n_records, any_value("Name") AS "Name", any_value("Vorname") AS "Vorname",
        arg_min("PatientID", row_number) AS "PatientID", min(row_number) AS first_row FROM counted GROUP BY run""".replace(") , found", "), found"),
    "q_redundant_flag": _REPORTS + f"""SELECT count(*) = 2 AND count(DISTINCT ("Name", "Vorname", "PatientID", "Geburtsdatum")) = 1 AS redundant
        FROM (SELECT * FROM records ORDER BY "PatientID", {_IN_ORDER} LIMIT 2)""",
    "q_txt_lines": _with(PATIENTS) + f"SELECT \"PatientID\", CAST(pos AS INTEGER) AS pos, line FROM ({_LINES})",
    "q_txt_report": _REPORTS + f"""SELECT "PatientID", any_value("Name") || chr(10) || any_value("Vorname") || chr(10) || "PatientID"
        || chr(10) || '---' || chr(10) || string_agg(concat_ws(chr(10), "Dauernotiz", "ICD10", "Bezeichnung"), chr(10) ORDER BY {_IN_ORDER}) AS report
        FROM records GROUP BY "PatientID\"""",
    "q_section_rows": _REPORTS + _SECTIONS,
    "q_json_doc": _REPORTS + f"""SELECT "PatientID", any_value({_INFO}) || '"diagnoses":[' || string_agg(
        '{{"Dauernotiz":"' || "Dauernotiz" || '","ICD10":' || {_quoted('"ICD10"')} || ',"Bezeichnung":' || {_quoted('"Bezeichnung"')}
        || coalesce(',"Date":"' || CAST("Date" AS VARCHAR) || '"', '') || '}}', ',' ORDER BY {_IN_ORDER}) || ']}}' AS document FROM records GROUP BY "PatientID\"""",
    "q_json_records": _REPORTS + f"""SELECT "PatientID", any_value({_INFO}) || '"records":[' || string_agg(
        '{{"PatientID":' || "PatientID" || ',"Vorname":"' || "Vorname" || '","Name":"' || "Name" || '","Geburtsdatum":"' || CAST("Geburtsdatum" AS VARCHAR)
        || '","Dauernotiz":"' || "Dauernotiz" || '","ICD10":' || {_quoted('"ICD10"')} || ',"Bezeichnung":' || {_quoted('"Bezeichnung"')}
        || ',"Date":' || {_quoted('CAST("Date" AS VARCHAR)')} || '}}', ',' ORDER BY {_IN_ORDER}) || ']}}' AS document FROM records GROUP BY "PatientID\"""",
    "q_split_keys": _with(PATIENTS) + f"""SELECT split_key, count(*) AS row_count, count(DISTINCT "PatientID") AS people
        FROM (SELECT *, {_KEY} AS split_key FROM patients) GROUP BY split_key""",
    "q_split_keys_unnamed": _with(PATIENTS) + """SELECT split_key, count(*) AS row_count, count(DISTINCT "PatientID") AS people FROM (
        SELECT "PatientID", CASE WHEN "PatientID" % 5 = 0 THEN 'output_' || "PatientID" ELSE regexp_replace("Name", '[^A-Za-z0-9_-]', '', 'g') END AS split_key
        FROM patients) GROUP BY split_key""",
    "q_run_status": _with(PATIENTS, IDS) + """, n AS (SELECT count(*) AS total, count(id) AS processed, count(DISTINCT CASE WHEN id IS NULL THEN raw_id END) AS failed FROM ids),
        f AS (SELECT count(*) AS row_count_fetched FROM ids JOIN patients p ON p."PatientID" = id)
        SELECT 'get_patient_by_id' AS query_name, '0.1.0' AS tool_version, CAST(0 AS BIGINT) AS execution_duration_ms, row_count_fetched, total, processed, failed,
        '{"input_csv":"ord...csv","id_column":"PatientID"}' AS parameters,
        CASE WHEN row_count_fetched > 0 AND processed = total THEN 'batch_success_all_processed' WHEN row_count_fetched > 0 AND processed > 0 THEN 'batch_partial_success'
          WHEN row_count_fetched > 0 OR total > 0 THEN 'batch_processed_no_data_or_all_failed' ELSE 'batch_input_error_or_empty' END AS status FROM n, f""",
    "q_audit_log": """SELECT event_type AS operation, CASE WHEN event_type <> 'error' THEN 'SUCCESS' ELSE 'FAILED' END AS status, value AS duration_ms, user_id AS row_count,
        'DB_AUDIT: ' || event_type || ' ' || CASE WHEN event_type <> 'error' THEN 'SUCCESS' ELSE 'FAILED' END || printf(', %.2fms', value) || ', ' || user_id || ' rows' AS line,
        'PATIENT_SEARCH: ' || event_type || ' search with 3 criteria returned ' || user_id || ' results' || printf(' (%.2fms)', value) AS search FROM events""",
}
