"""Stable global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import ROW_ID
from ..session import settle

_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str | Column], out: str = ROW_ID) -> DataFrame:
    """Add the 0-based place of each row in ``order``.

    Rows are range-partitioned and sorted, then each partition starts where
    the ones before it end; only one count for each partition reaches the
    driver. ``order`` should be total: rows that tie are numbered as they come.
    """
    return placed(df.repartitionByRange(*order).sortWithinPartitions(*order), out)


def placed(df: DataFrame, out: str) -> DataFrame:
    """Add the 0-based place of each row in the order that ``df`` has."""
    return placed_and_counted(df, out)[0]


def placed_and_counted(df: DataFrame, out: str) -> tuple[DataFrame, int]:
    """The same, and how many rows there are, which numbering them tells."""
    marked = settle(df).withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", 33))
    counts = marked.groupBy("__part").count().orderBy("__part").collect()
    begin, offsets = 0, []
    for r in counts:
        offsets.append((r["__part"], begin))
        begin += r["count"]
    # A row for each partition, so the table is small whatever the input.
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __shift long"))
    return marked.join(shift, "__part").select(*df.columns, (F.col("__m").bitwiseAND(F.lit(_PLACE)) + F.col("__shift")).alias(out)), begin
