"""Writers: JSON, CSV, TSV and text, whole or split by a key made of columns."""

from __future__ import annotations

import os
import warnings
from string import Formatter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import iso_text, sanitise
from ..model import FORMAT_BY_SUFFIX, FORMATS, ID
from ..operators.report import cell_text


def output_format(fmt: str | None, path: str) -> str:
    """The format asked for, else the one the path's ending implies, else JSON."""
    if fmt:
        if fmt not in FORMATS:
            raise ValueError(f"unknown format {fmt!r}; use one of {', '.join(FORMATS)}")
        return fmt
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMAT_BY_SUFFIX:
        warnings.warn(f"no known format for {path!r}; writing json", stacklevel=3)
    return FORMAT_BY_SUFFIX.get(suffix, "json")


def split_key(df: DataFrame, template: str = "{PatientID}", row_column: str | None = None, id_column: str = ID) -> Column:
    """Sanitised key such as ``"{Vorname}_{Name}"``; an empty key becomes ``output_`` and the row number.

    Without a row column the person's id takes its place, so people without a key stay apart.
    """
    parts = []
    for text, name, spec, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is None:
            continue
        if name not in df.columns or spec:
            raise ValueError(f"template field {name!r} is not a column, or has a format")
        value = iso_text(name, df.schema[name].dataType)
        parts.append(F.coalesce(value, F.lit("None")))
    if not row_column and id_column not in df.columns:
        raise ValueError(f"rows without a key are numbered by a row column or by {id_column!r}; there is neither")
    row = F.coalesce(F.col(row_column or id_column).cast("string"), F.lit("None"))
    key = sanitise(F.concat(*parts))
    return F.when(key == "", F.concat(F.lit("output_"), row)).otherwise(key)


def split_counts(df: DataFrame, template: str = "{PatientID}", row_column: str | None = None,
                 id_column: str = "PatientID") -> DataFrame:
    """Rows per key, and how many people share it (more than one when sanitising makes keys equal)."""
    keyed = df.select(split_key(df, template, row_column, id_column).alias("split_key"), F.col(id_column).alias("_id"))
    return keyed.groupBy("split_key").agg(F.count("*").alias("row_count"), F.count_distinct("_id").alias("people"))


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, times in ISO form."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_text(c, f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def _lines(df: DataFrame, keep: list[str]) -> DataFrame:
    text = F.array_join(F.array(*[cell_text(df, c) for c in df.columns if c not in keep]), "\n")
    return df.select(text.alias("value"), *keep).where(F.length("value") > 0)


def write_results(df: DataFrame, path: str, fmt: str | None = None, split_by: str | None = None,
                  row_column: str | None = None, metadata: DataFrame | None = None, mode: str = "error",
                  buckets: int | None = None, id_column: str = ID) -> int:
    """Write a result and tell how many rows it has, counted as they are written.

    With ``split_by`` there is one folder per key, large keys in several files, and the number of rows of
    each key beside them in ``<path>.counts``. For very many keys ``buckets`` makes so many folders by a hash of the key,
    which then stays in the files as the column ``split_key``. ``metadata`` (see ``run_summary``) goes
    beside the result, to ``<path>.metadata``.
    """
    fmt = output_format(fmt, path)
    written = Observation()
    df = df.observe(written, F.count(F.lit(1)).alias("rows"))
    keep = []
    if split_by:
        df, keep = _split(df, split_key(df, split_by, row_column, id_column), buckets)
    out = _lines(df, keep) if fmt == "txt" else df if fmt == "json" else _flat(df)
    if buckets and fmt == "txt":
        raise ValueError("text files have no room for the key of a bucket's rows")
    writer = out.write.mode(mode)
    if split_by:
        writer = writer.partitionBy(keep[-1])
    if fmt == "json":
        writer.option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)
    elif fmt == "txt":
        writer.text(path)
    else:
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"') \
            .option("emptyValue", "").csv(path)
    if split_by:
        _write_counts(df, path, mode)
    if metadata is not None:
        metadata.write.mode(mode).json(path.rstrip("/") + ".metadata")
    return written.get["rows"]


def _split(df: DataFrame, key: Column, buckets: int | None) -> tuple[DataFrame, list[str]]:
    """Rows dealt by key, and the columns that say where they go."""
    df = df.withColumn("split_key", key)
    if buckets:
        df = df.withColumn("bucket", F.pmod(F.xxhash64("split_key"), F.lit(buckets)))
        return df.hint("rebalance", "bucket"), ["split_key", "bucket"]
    return df.hint("rebalance", "split_key"), ["split_key"]


def _write_counts(df: DataFrame, path: str, mode: str) -> None:
    counts = df.groupBy("split_key").agg(F.count(F.lit(1)).alias("row_count_fetched"))
    counts.write.mode(mode).json(path.rstrip("/") + ".counts")


def write_reports(reports: DataFrame, path: str, column: str = "report", rule: str = "===", mode: str = "error",
                  split_by: str | None = None, row_column: str | None = None, id_column: str = ID) -> None:
    """Write one text per row, a rule between texts; with ``split_by`` one folder per key, as :func:`write_results`."""
    if not split_by:
        reports.select(column).write.mode(mode).option("lineSep", f"\n{rule}\n").text(path)
        return
    df, _ = _split(reports, split_key(reports, split_by, row_column, id_column), None)
    df.select(column, "split_key").write.mode(mode).partitionBy("split_key").option("lineSep", f"\n{rule}\n").text(path)
    _write_counts(df, path, mode)
