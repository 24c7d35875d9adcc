"""Relational operators over masked tables.

A masked table carries a row id and an activity mask; filters, limits and
aggregates clear the mask instead of dropping rows. For every operator,
``compact(op(t))`` holds the same rows as the plain operator on ``compact(t)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prep import pad_pow2
from ..functions.rows import numbered
from ..names import ACTIVE, ROW_ID, SYSTEM, data_columns
from .joinmode import MANY_TO_ONE, ONE_TO_MANY, ONE_TO_ONE, Keys, join_mode


def compact(df: DataFrame) -> DataFrame:
    """The active rows without system columns."""
    return df.where(F.col(ACTIVE)).select(*[f"`{c}`" for c in data_columns(df.columns)])


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns, ROW_ID, ACTIVE)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Keep the mask where the predicate is true; null counts as false."""
    return df.withColumn(ACTIVE, F.col(ACTIVE) & F.coalesce(predicate, F.lit(False)))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Of the active rows by row id keep those from ``offset`` on, ``n`` at most."""
    window = df.where(F.col(ACTIVE)).select(ROW_ID).orderBy(ROW_ID).offset(offset).limit(n).agg(F.min(ROW_ID).alias("__from"), F.max(ROW_ID).alias("__to"))
    kept = F.col(ACTIVE) & F.coalesce(F.col(ROW_ID).between(F.col("__from"), F.col("__to")), F.lit(False))
    return df.crossJoin(F.broadcast(window)).withColumn(ACTIVE, kept).select(*[f"`{c}`" for c in df.columns])  # one row


def sort(df: DataFrame, *keys: Column) -> DataFrame:
    """Active rows first, then by keys, then by row id."""
    return df.orderBy(F.desc(ACTIVE), *keys, F.asc(ROW_ID))


def aggregate(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Every row carries its group's values; only the first active row of a group stays active.

    The groups are aggregated with map-side partial sums and joined back on
    null-safe keys, so a group with a third of the rows is neither sorted nor
    held by one task. Null keys form a group of their own.
    """
    active = df.where(F.col(ACTIVE))
    groups = active.groupBy(*keys).agg(F.min(ROW_ID).alias("__first"), *[a.alias(name) for name, a in aggregates.items()])
    left, right = df.select(*keys, *SYSTEM).alias("l"), groups.alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]) if keys else F.lit(True)
    joined = left.join(right if keys else F.broadcast(right), same, "left")  # without keys the right side is one row
    first = F.col(f"l.{ACTIVE}") & F.coalesce(F.col(f"l.{ROW_ID}") == F.col("r.__first"), F.lit(False))
    return joined.select(*[f"l.`{k}`" for k in keys], *[f"r.`{a}`" for a in aggregates], f"l.{ROW_ID}", first.alias(ACTIVE))


def _sides(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, Column]:
    l, r = left.alias("l"), right.alias("r")
    return l, r, reduce(lambda a, b: a & b, [F.col(f"l.`{a}`") == F.col(f"r.`{b}`") for a, b in on])


def join_many(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join the active rows; ids are new, in the order of both sides' ids, and all rows are active.

    Columns of both sides must have different names. ``how`` may be inner,
    left, right or full.
    """
    l, r, same = _sides(left.where(F.col(ACTIVE)).withColumnRenamed(ROW_ID, "__lid").drop(ACTIVE), right.where(F.col(ACTIVE)).withColumnRenamed(ROW_ID, "__rid").drop(ACTIVE), on)
    joined = numbered(l.join(r, same, how), [F.col("__lid").asc_nulls_first(), F.col("__rid").asc_nulls_first()])
    return joined.drop("__lid", "__rid").withColumn(ACTIVE, F.lit(True))


def join_key(fk: DataFrame, pk: DataFrame, on: list[tuple[str, str]], checked: bool = True) -> DataFrame:
    """Join to a side of unique keys: all rows of ``fk`` stay with their ids; those without an active partner go inactive.

    Unless ``checked`` is off, the keys are first verified to be unique, as a
    duplicate would multiply rows. Whether the key side is broadcast is left
    to Spark, which knows its size.
    """
    keys = pk.where(F.col(ACTIVE))
    if checked and keys.groupBy(*[b for _, b in on]).count().where("count > 1").limit(1).count():
        raise ValueError("the key side is not unique")
    l, r, same = _sides(fk, keys.drop(*SYSTEM).withColumn("__found", F.lit(True)), on)
    joined = l.join(r, same, "left").withColumn("__on", F.col(ACTIVE) & F.coalesce(F.col("__found"), F.lit(False)))
    return joined.select(*[f"l.`{c}`" for c in data_columns(fk.columns)], *[f"r.`{c}`" for c in data_columns(pk.columns)], ROW_ID, F.col("__on").alias(ACTIVE))


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_keys: Keys, right_keys: Keys, how: str = "inner", checked: bool = True) -> DataFrame:
    """Join as the declared keys allow: a side that refers to unique keys keeps its rows and ids, any other join makes new ones.

    ``left_keys`` and ``right_keys`` say what is known of the sides, also
    whether they are filtered. Columns come in the order left, right.
    """
    mode = join_mode(left_keys, right_keys, on, how)
    if mode in (MANY_TO_ONE, ONE_TO_ONE):
        return join_key(left, right, on, checked)
    if mode == ONE_TO_MANY:
        names = [f"`{c}`" for c in (*data_columns(left.columns), *data_columns(right.columns), *SYSTEM)]
        return join_key(right, left, [(b, a) for a, b in on], checked).select(*names)
    return join_many(left, right, on, how)


def rematerialize(df: DataFrame) -> DataFrame:
    """The active rows alone, numbered anew in the order of their ids and padded to a power of two."""
    active = df.where(F.col(ACTIVE)).withColumnRenamed(ROW_ID, "__old")
    return pad_pow2(numbered(active, [F.col("__old")]).drop("__old").select(*df.columns))
