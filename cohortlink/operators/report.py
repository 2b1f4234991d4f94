"""Per-person reports: grouped records, JSON documents, sectioned text and sectioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_text, strip
from ..model import ID, PATIENT_FIELDS, VARYING_FIELDS
from .skew import run_numbers


def person_fields(df: DataFrame) -> list[str]:
    return [c for c in PATIENT_FIELDS if c in df.columns]


def record_fields(df: DataFrame, leave: list[str] | None = None) -> list[str]:
    """Fields that vary from record to record."""
    return [c for c in df.columns if c not in PATIENT_FIELDS and c not in (leave or [])]


def cell_text(df: DataFrame, name: str, dates: bool = False) -> Column:
    """Text of a number, flag or string, trimmed; null for blanks and, unless asked for, dates."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        plain = F.regexp_replace(c.cast("string").cast("decimal(38,17)").cast("string"), r"(\.\d+?)0+$", "$1")
        size = F.abs(c)
        text = F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), plain) \
            .otherwise(c.cast("string"))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        text = iso_text(c, kind)
    elif isinstance(kind, T.StringType):
        text = strip(c)
    elif dates and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = iso_text(c, kind)
    else:
        return F.lit(None).cast("string")
    return F.when(F.length(text) > 0, text)


def value_lines(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per printable cell, in column order, beside the columns ``keep`` that identify the record."""
    cells = F.array(*[cell_text(df, c) for c in df.columns if c not in keep])
    return df.select(*keep, F.posexplode(cells).alias("pos", "line")).where(F.col("line").isNotNull())


def _json_value(df: DataFrame, name: str) -> Column:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        return F.coalesce(c.cast("string"), F.lit("null"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.concat(F.lit('"'), iso_text(c, kind), F.lit('"')), F.lit("null"))
    text = F.to_json(F.array(c))
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    if isinstance(kind, T.StringType):
        # Most strings need no escaping.
        text = F.when(c.rlike(r'["\\\x00-\x1f]'), text).otherwise(F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null")))
    return text


def json_object(df: DataFrame, names: list[str], keep_null: list[str]) -> Column:
    """JSON object of the named columns; null fields are left out unless listed."""
    parts = []
    for n in names:
        part = F.concat(F.lit(f'"{n}":'), _json_value(df, n))
        parts.append(part if n in keep_null else F.when(F.col(f"`{n}`").isNotNull(), part))
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def _grouped(df: DataFrame, record: Column, order: list[str], group: list[str]) -> DataFrame:
    """Rows ``(_group…, the person's fields, records, n_records)``; the fields are those of the first record in order.

    All records of one person are held by one task; see :func:`report_rows` for the form without that bound.
    """
    fields = person_fields(df)
    slim = df.select(*[F.col(g).alias(f"_{g}") for g in group], F.struct(*order).alias("_order"),
                     F.struct(*fields).alias("_info"), record.alias("_record"))
    keys = [f"_{g}" for g in group]
    return slim.groupBy(*keys).agg(
        F.min_by("_info", "_order").alias("info"),
        F.transform(F.sort_array(F.collect_list(F.struct("_order", "_record"))), lambda r: r["_record"]).alias("records"),
        F.count("*").alias("n_records")).select(*keys, "info.*", "records", "n_records")


def _by(df: DataFrame, mode: str, order: list[str], group: str) -> tuple[DataFrame, list[str]]:
    if mode == "entity":
        return df, [group]
    if mode == "runs":
        return run_numbers(df, [c for c in ("Name", "Vorname") if c in df.columns], order), ["run"]
    raise ValueError(f"unknown mode {mode!r}")


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(f"_{k}").alias(k) for k in keys]


def grouped_report(df: DataFrame, order: list[str], mode: str = "entity", group: str = ID,
                   leave: list[str] | None = None) -> DataFrame:
    """One row per person (or per run of rows about one person): fields of the person and an array of records.

    Every row is complete and in order, and made by one task, as are the two forms below.
    """
    fields, varying = person_fields(df), record_fields(df, leave)
    df, keys = _by(df, mode, order, group)
    out = _grouped(df, F.struct(*varying), order, keys)
    return out.select(*_keys(keys), F.struct(*fields).alias("patient_info"), "records", "n_records")


def json_documents(df: DataFrame, order: list[str], mode: str = "entity", group: str = ID, whole_rows: bool = False,
                   leave: list[str] | None = None) -> DataFrame:
    """One JSON document per person: ``patient_info`` once, then ``diagnoses`` (or whole ``records``)."""
    left_out = leave or []
    fields = person_fields(df)
    names = [c for c in df.columns if c not in left_out] if whole_rows else record_fields(df, leave)
    df, keys = _by(df, mode, order, group)
    record = json_object(df, names, names if whole_rows else VARYING_FIELDS)
    out = _grouped(df, record, order, keys)
    label = "records" if whole_rows else "diagnoses"
    return out.select(*_keys(keys), F.concat(
        F.lit('{"patient_info":'), json_object(out, fields, []), F.lit(f',"{label}":['), F.array_join("records", ","),
        F.lit("]}")).alias("document"))


def text_report(df: DataFrame, order: list[str], mode: str = "entity", group: str = ID, dates: bool = False,
                leave: list[str] | None = None) -> DataFrame:
    """One text per person: lines of the person, a rule, then one line per value of each record."""
    fields, varying = person_fields(df), record_fields(df, leave)
    df, keys = _by(df, mode, order, group)
    record = F.array_join(F.array(*[cell_text(df, c) for c in varying]), "\n")
    out = _grouped(df, record, order, keys)
    info = F.array_join(F.array(*[cell_text(out, c, dates) for c in fields]), "\n")
    lines = F.filter(F.concat(F.array(info, F.lit("---")), F.col("records")), lambda x: x != "")
    return out.select(*_keys(keys), F.array_join(lines, "\n").alias("report"))


def section_rows(df: DataFrame, order: list[str], group: str = ID, leave: list[str] | None = None) -> DataFrame:
    """Rows ``section, field, value``: once per person, then per record under sorted field names.

    Records are told apart by the order columns, which are null in the rows of the person.
    """
    def cells(names):
        return F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(cell_text(df, n, True), F.lit("")).alias("value"),
                                  F.col(f"`{n}`").isNull().alias("gone")) for n in names])
    fields, varying = person_fields(df), sorted(record_fields(df, leave))
    people = df.groupBy(F.col(group).alias("_group")).agg(F.min_by(cells(fields), F.struct(*order)).alias("cells"))
    people = people.select(F.col("_group").alias(group), F.lit("Patient").alias("section"),
                           F.posexplode("cells").alias("seq", "cell")).where(~F.col("cell.gone"))
    records = df.select(F.col(group), F.lit("Diagnoses").alias("section"), *[F.col(o).alias(f"order_{o}") for o in order],
                        F.posexplode(cells(varying)).alias("seq", "cell"))
    shown = ~F.col("cell.gone") | F.col("cell.field").isin(VARYING_FIELDS)
    return people.unionByName(records.where(shown), allowMissingColumns=True) \
        .select("*", "cell.field", "cell.value").drop("cell")


def report_rows(df: DataFrame, order: list[str], group: str = ID, leave: list[str] | None = None) -> DataFrame:
    """:func:`section_rows` laid out in order of persons and records, ready to be written.

    Partitions are ranges of person and order, so a person with very many records takes several, and nothing
    of a person has to be held at once.
    """
    rows = section_rows(df, order, group, leave)
    place = [F.col(group), F.col("section") != "Patient", *[F.col(f"order_{o}") for o in order], F.col("seq")]
    return rows.repartitionByRange(*place).sortWithinPartitions(*place)


def record_lines(df: DataFrame, order: list[str], group: str = ID, leave: list[str] | None = None) -> DataFrame:
    """One JSON object per record, ``(group, line)``, in order of persons and records, laid out as :func:`report_rows`."""
    names = [c for c in df.columns if c not in (leave or [])]
    place = [group, *order]
    laid = df.repartitionByRange(*place).sortWithinPartitions(*place)
    return laid.select(group, json_object(df, names, names).alias("line"))


def distinct_people(df: DataFrame) -> DataFrame:
    """Number of different (Name, Vorname), rows with neither left out."""
    known = df.where(F.col("Name").isNotNull() | F.col("Vorname").isNotNull())
    return known.agg(F.count_distinct(F.struct("Name", "Vorname")).alias("people"))


def redundant(df: DataFrame, order: list[str]) -> DataFrame:
    """Whether the first two records, in order, repeat the fields of one person; one row."""
    fields = person_fields(df)
    if not fields or not [c for c in VARYING_FIELDS if c in df.columns]:
        return df.sparkSession.range(1).select(F.lit(False).alias("redundant"))
    info = F.struct(*fields)
    first = df.orderBy(*order).limit(2).select(info.alias("info"))
    return first.agg(((F.count("*") == 2) & F.min("info").eqNullSafe(F.max("info"))).alias("redundant"))
