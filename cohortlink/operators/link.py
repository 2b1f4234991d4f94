"""Join of any number of tables around the id of a person."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_strings
from ..model import ID
from .skew import among, padded

# The id always filters the primary table, so what only other tables hold goes.
JOINS = {"LEFT": "left", "INNER": "inner", "RIGHT": "inner", "FULL": "left"}


@dataclass(frozen=True)
class TableSpec:
    """A table, the columns wanted from it (all when empty) and the column holding the person's id."""

    name: str
    df: DataFrame
    columns: list[str] = field(default_factory=list)
    id_column: str = ID

    def chosen(self) -> list[str]:
        return list(self.columns) or self.df.columns


def order_keys(order_by: list[str]) -> list[Column]:
    """Sort keys from texts such as ``"Date DESC"``."""
    keys = []
    for text in order_by:
        name, _, way = text.partition(" ")
        if way.strip().upper() not in ("", "ASC", "DESC"):
            raise ValueError(f"unknown sort direction in {text!r}")
        keys.append(F.col(name).desc() if way.strip().upper() == "DESC" else F.col(name).asc())
    return keys


def _star(primary: TableSpec, others: list[TableSpec], how: str) -> tuple[DataFrame, list[str]]:
    """Joined tables and the output columns; a name seen before becomes ``{table}_{column}``."""
    names = {c: c for c in primary.chosen()}
    df = primary.df.select(F.col(primary.id_column).alias("_id"), *[F.col(c) for c in primary.chosen()])
    taken = set(primary.chosen())
    for k, table in enumerate(others):
        renamed = []
        for c in table.chosen():
            out = c if c not in taken else f"{table.name}_{c}"
            if out in taken:
                raise ValueError(f"column {out!r} occurs twice; give {table.name!r} another name")
            taken.add(out)
            renamed.append(F.col(c).alias(out))
            names[out] = out
        side = table.df.select(F.col(table.id_column).alias(f"_id{k}"), *renamed)
        # All tables are shuffled once, by the same id; none is broadcast, as nothing bounds its size.
        if how == "left":
            side = padded(side, f"_id{k}", primary.df.select(F.col(primary.id_column).alias(f"_id{k}")))
        df = df.join(side.hint("merge"), F.col("_id") == F.col(f"_id{k}")).drop(f"_id{k}")
    return df, list(names)


def _reduced(table: TableSpec, wanted: DataFrame, column: str) -> TableSpec:
    """The rows of the ids asked for, before anything is cleaned or joined."""
    ids = wanted.withColumnRenamed(column, table.id_column)
    return TableSpec(table.name, among(table.df, ids, table.id_column), table.chosen(), table.id_column)


def _first_rows(primary: TableSpec, others: list[TableSpec], order_by: list[str], limit: int) -> list[TableSpec]:
    """``others``, the one that holds all sort columns cut to its first ``limit`` rows per id.

    The join gives every row of one id in a table as many partners, so its first rows come out of these.
    """
    names = [text.partition(" ")[0] for text in order_by]
    taken = set(primary.chosen())
    for k, table in enumerate(others):
        if names and set(names) <= set(table.chosen()) - taken:
            rank = F.row_number().over(Window.partitionBy(table.id_column).orderBy(*order_keys(order_by)))
            few = table.df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
            return [*others[:k], TableSpec(table.name, few, table.chosen(), table.id_column), *others[k + 1:]]
        taken |= set(table.chosen())
    return others


def link_tables(primary: TableSpec, others: list[TableSpec], ids: DataFrame | int | None = None, how: str = "LEFT",
                order_by: list[str] | None = None, limit: int | None = None, where: list[Column] | None = None,
                clean: bool = True) -> DataFrame:
    """Star join of ``others`` to ``primary`` for one id, for a batch of id requests, or for everyone.

    The id always filters the primary table, so RIGHT acts as INNER and FULL as LEFT. In a batch,
    each distinct id is joined (and limited) once, then its rows are given to every request for it.
    """
    if how.upper() not in JOINS:
        raise ValueError(f"unknown join type {how!r}; use one of {', '.join(JOINS)}")
    if isinstance(ids, DataFrame):
        wanted = ids.where(F.col("id").isNotNull()).select(F.col("id").alias(primary.id_column)).distinct()
        primary, *others = [_reduced(t, wanted, primary.id_column) for t in (primary, *others)]
    elif isinstance(ids, int):
        primary, *others = [TableSpec(t.name, t.df.where(F.col(t.id_column) == ids), t.chosen(), t.id_column)
                            for t in (primary, *others)]
    if isinstance(ids, DataFrame) and limit and not where:
        others = _first_rows(primary, others, order_by or [], limit)
    # Cells are cleaned before the join multiplies them, unless conditions or sorting need them as stored.
    early = clean and not where and not order_by
    if early:
        primary, *others = [TableSpec(t.name, clean_strings(t.df.select(*dict.fromkeys([t.id_column, *t.chosen()]))),
                                      t.chosen(), t.id_column) for t in (primary, *others)]
    clean = clean and not early
    df, columns = _star(primary, others, JOINS[how.upper()])
    df = df.where(F.col("_id").isNotNull())
    for condition in where or []:
        df = df.where(condition)
    keys = order_keys(order_by or [])
    if isinstance(ids, DataFrame):
        if limit:
            rank = F.row_number().over(Window.partitionBy("_id").orderBy(*(keys or [F.lit(1)])))
            df = df.withColumn("_rank", rank).where(F.col("_rank") <= limit)
        df = clean_strings(df) if clean else df
        requests = ids.where(F.col("id").isNotNull()).select("row_number", F.col("id").alias("_id"))
        df = requests.join(df, "_id").select("row_number", *columns)
        return df.orderBy("row_number", *keys) if keys else df
    df = df.select(*columns)
    df = df.orderBy(*keys) if keys else df
    df = df.limit(limit) if limit else df
    return clean_strings(df) if clean else df
