"""Column expressions and materialisation shared by the llm operators."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, delete, settle

__all__ = ["ALNUM_WORD", "SPACE_WORD", "ascii_lower", "bounded_broadcast", "checkpoint_dir", "columns", "delete", "digest", "settle", "sampled_texts", "smallest", "stored", "table", "temporary", "unused", "words"]

#: Words of ASCII letters and digits and of anything beyond ASCII, in text whose A-Z are lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` also folds letters beyond ASCII, so it serves only texts without
    any; it is many times faster than ``translate`` and most texts qualify.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def bounded_broadcast(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows stay under the bound; else leave the join to Spark."""
    return F.broadcast(df) if rows <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def digest(text: Column) -> Column:
    """32 bytes that stand for a text; null for null."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end; what reads them has to be written by then."""
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for folder in written:
            delete(spark, folder)


def stored(df: DataFrame, row: str) -> DataFrame:
    """``df`` with a number ``row`` of each row, in the shared folder.

    A row number given while a plan runs changes when the plan runs again, be
    it for another column or a lost executor; one that is read back does not.
    """
    folder = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(folder)
    void = {c for c, kind in df.dtypes if kind == "void"}  # Parquet has no such type
    kept = [c for name, c in zip(df.columns, columns(df), strict=True) if name not in void]
    df.select(*kept, F.monotonically_increasing_id().alias(row)).write.parquet(folder)
    back = df.sparkSession.read.parquet(folder)
    return back.select(*[F.lit(None).alias(name) if name in void else c for name, c in zip(df.columns, columns(df), strict=True)], row)


def smallest(df: DataFrame, group: str, draw: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the smallest ``draw``, a 64-bit hash of something unique.

    Draws are counted in 4,096 cells first, so that a task ranks about ``k``
    rows of a group and not all of them.
    """
    cells = settle(df.withColumn("__cell", F.shiftrightunsigned(draw, 52)))
    upto = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.groupBy(group, "__cell").agg(F.count("*").alias("n")).withColumn("sum", F.sum("n").over(upto))
    cuts = counted.groupBy(F.col(group).alias("__group")).agg(F.coalesce(F.min(F.when(F.col("sum") >= k, F.col("__cell"))), F.lit(4096)).alias("__cut"))
    cuts = settle(cuts)
    near = cells.join(bounded_broadcast(cuts, cuts.count(), 20_000), F.col(group) == F.col("__group")).where("__cell <= __cut")
    ranked = near.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(draw)))
    return ranked.where(F.col("__n") <= k).select(*df.columns)


def sampled_texts(rated: DataFrame, group: str, text: str, k: int) -> DataFrame:
    """(group, text): at most ``k`` different texts of each group, those of the smallest hashes, the same ones at every run.

    Copies count once, so what is returned is bounded by the number of groups
    and ``k`` whatever the table repeats; rows of a null group or text are none.
    """
    keyed = rated.select(F.col(group).alias("group"), F.col(text).alias("text")).where("group is not null and text is not null").withColumn("h", digest(F.col("text")))
    chosen = settle(smallest(keyed.select("group", "h").distinct().withColumn("draw", F.xxhash64("h")), "group", "draw", k).select("group", "h"))
    picked = keyed.join(bounded_broadcast(chosen, chosen.count(), 50_000), ["group", "h"], "left_semi")
    return picked.groupBy("group", "h").agg(F.first("text").alias("text")).select("group", "text")
