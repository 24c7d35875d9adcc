"""Normalising a table on load.

Dates get their parts as columns, floats become decimal(18,3), then come the
row id and the activity mask, and the table is padded to a power of two with
inactive rows of nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import ACTIVE, ROW_ID, next_power_of_two
from .rows import placed_and_counted
from .types import DECIMAL


def expand_dates(df: DataFrame) -> DataFrame:
    """Year, month and day after each date; for timestamps also the second of the day."""
    out: list[Column] = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        out.append(c)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out += [fn(c).cast("int").alias(f"{f.name}_{part}") for part, fn in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))]
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append((F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("int").alias(f"{f.name}_time"))
    return df.select(*out)


def as_decimal(c: Column) -> Column:
    """decimal(18,3), halves rounded away from zero; null for what is not finite or too large."""
    return c.try_cast(DECIMAL)


def decimalize(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[as_decimal(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def comparison_variant(df: DataFrame) -> DataFrame:
    """Floats times 1000, truncated; decimals as their unscaled integers; negatives become null."""
    out: list[Column] = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            scaled = F.floor(c * 1000)
        elif isinstance(f.dataType, T.DecimalType):
            scaled = c * F.lit(10**f.dataType.scale)
        else:
            out.append(c)
            continue
        out.append(F.when(c >= 0, scaled.try_cast("decimal(20,0)")).alias(f.name))
    return df.select(*out)


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def add_row_id(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Number the rows from 0 by ``key``, then by all other columns, nulls first."""
    return row_ids(df, key)[0]


def row_ids(df: DataFrame, key: list[str] | None = None) -> tuple[DataFrame, int]:
    """The numbered rows and how many they are."""
    rest = [c for c in df.columns if c not in (key or [])]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in [*(key or []), *rest]]
    return placed_and_counted(df.repartitionByRange(*order).sortWithinPartitions(*order), ROW_ID)


def add_mask(df: DataFrame) -> DataFrame:
    return df.withColumn(ACTIVE, F.lit(True))


def pad_pow2(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Append inactive rows of nulls, their ids going on, up to the next power of two; none to an empty table."""
    n = df.count() if rows is None else rows
    missing = next_power_of_two(n) - n
    if not missing:
        return df
    pad = df.sparkSession.range(n, n + missing).select(
        *[F.col("id").alias(ROW_ID) if f.name == ROW_ID else F.lit(False).alias(ACTIVE) if f.name == ACTIVE else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    )
    return df.unionByName(pad)


def preprocess(df: DataFrame, key: list[str] | None = None, without_nulls: bool = False, raw: bool = False) -> DataFrame:
    """The whole normalisation; ``raw`` only expands the dates."""
    out = expand_dates(df)
    if raw:
        return out
    out = decimalize(out)
    if without_nulls:
        out = drop_null_rows(out)
    ids, n = row_ids(out, key)
    return pad_pow2(add_mask(ids), n)
