"""Certificate checks: each returns the rows that violate it, so an empty result is a pass.

None collects rows; all are joins, grouped counts or differences that Spark
distributes. ``holds`` turns a result into a verdict with a limit of one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import numbered
from ..names import ACTIVE, ROW_ID


def holds(violations: DataFrame) -> bool:
    return not violations.limit(1).count()


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in columns])


def filter_check(before: DataFrame, after: DataFrame, predicate: Column) -> DataFrame:
    """The mask after is the mask before and the predicate, on every row."""
    expected = before.select(ROW_ID, (F.col(ACTIVE) & F.coalesce(predicate, F.lit(False))).alias("want"))
    return expected.join(after.select(ROW_ID, F.col(ACTIVE).alias("got")), ROW_ID, "full").where(~F.col("want").eqNullSafe(F.col("got")))


def _by_id(a: DataFrame, b: DataFrame, columns: list[str], wrong) -> DataFrame:
    """Rows of both under one id that are ``wrong`` together, and those of either without a partner."""
    x, y = a.select(ROW_ID, *columns).withColumn("__a", F.lit(True)).alias("a"), b.select(ROW_ID, *columns).withColumn("__b", F.lit(True)).alias("b")
    joined = x.join(y, F.col(f"a.{ROW_ID}").eqNullSafe(F.col(f"b.{ROW_ID}")), "full")
    alone = F.col("__a").isNull() | F.col("__b").isNull()
    return joined.where(alone | wrong(_same("a", "b", columns))).select(F.coalesce(f"a.{ROW_ID}", f"b.{ROW_ID}").alias(ROW_ID), *[F.col(f"a.`{c}`") for c in columns])


def equal(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Both have the same ids, and rows of one id agree in all columns."""
    return _by_id(a, b, columns, lambda same: ~same)


def unequal(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Both have the same ids, and rows of one id differ in some column."""
    return _by_id(a, b, columns, lambda same: same)


def boolean(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).cast("int").isin(0, 1), F.lit(False)))


def at_least(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(a) >= F.col(b), F.lit(False)))


def at_most(df: DataFrame, a: str, b: str) -> DataFrame:
    return at_least(df, b, a)


_SIGNS = {"non_negative": lambda c: c >= 0, "negative": lambda c: c < 0, "non_positive": lambda c: c <= 0, "positive": lambda c: c > 0}


def sign(df: DataFrame, **kinds: str) -> DataFrame:
    """Each named column has the sign given for it: non_negative, negative, non_positive or positive."""
    fits = [F.coalesce(_SIGNS[kind](F.col(c)), F.lit(False)) for c, kind in kinds.items()]
    return df.where(~reduce(lambda a, b: a & b, fits))


def lookup(included: DataFrame, super_: DataFrame, columns: list[str]) -> DataFrame:
    """Every row of ``included`` occurs in ``super_``."""
    x, y = included.select(*columns).alias("a"), super_.select(*columns).distinct().alias("b")
    return x.join(y, _same("a", "b", columns), "left_anti")


def multiplicities(included: DataFrame, super_: DataFrame, columns: list[str]) -> DataFrame:
    """For each different row of ``super_``, how often ``included`` has it."""
    n = included.groupBy(*columns).agg(F.count("*").alias("multiplicity")).alias("b")
    x = super_.select(*columns).distinct().alias("a")
    return x.join(n, _same("a", "b", columns), "left").select(*[f"a.`{c}`" for c in columns], F.coalesce("multiplicity", F.lit(0)).cast("long").alias("multiplicity"))


def keyed_sum(a: DataFrame, b: DataFrame, keys: list[str], weight_a: Column | None = None, weight_b: Column | None = None) -> DataFrame:
    """Weights sum to the same for every key on both sides; without weights, keys occur equally often."""
    one = F.lit(1).cast("long")
    signed = a.select(*keys, (weight_a if weight_a is not None else one).alias("w")).union(b.select(*keys, (-(weight_b if weight_b is not None else one)).alias("w")))
    return signed.groupBy(*keys).agg(F.sum("w").alias("surplus")).where("surplus <> 0")


def permutation(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Both hold the same rows, each as often: one shuffle of partial counts, whatever the multiplicity."""
    return keyed_sum(a, b, columns or a.columns)


def prescribed_permutation(left: DataFrame, right: DataFrame, target: Column, columns: list[str]) -> DataFrame:
    """The row of ``right`` with id i equals the row of ``left`` with id ``target``, an expression of i."""
    x, y = right.withColumn("__at", target).alias("a"), left.alias("b")
    return x.join(y, F.col("a.__at") == F.col(f"b.{ROW_ID}"), "left").where(F.col(f"b.{ROW_ID}").isNull() | ~_same("a", "b", columns)).select(f"a.{ROW_ID}")


def cyclic_shift(left: DataFrame, right: DataFrame, n: int, columns: list[str], by: int = 1) -> DataFrame:
    return prescribed_permutation(left, right, (F.col(ROW_ID) + by) % n, columns)


def _neighbours(df: DataFrame, columns: list[str], position: str) -> tuple[DataFrame, DataFrame]:
    """(position, x0, ...) and (y0, ...) of each row and the one after it, under the place ``__p`` of the former.

    Positions may have gaps, as those of filtered tables do: rows are numbered
    densely first. The next row is found by a join, so no task holds more
    than its share.
    """
    rows = numbered(df.select(F.col(position).alias("__at"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)]), ["__at"], "__p")
    after = rows.select((F.col("__p") - 1).alias("__p"), F.col("__at").alias("__next"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(len(columns))])
    return rows, after


def sorted_rows(df: DataFrame, keys: list[tuple[str, bool]], strict: bool = False, position: str = ROW_ID) -> DataFrame:
    """Rows by ``position`` are in lexicographic order of (column, ascending), nulls lowest; ``strict`` forbids ties.

    Gives the positions of rows that the next one should not follow.
    """
    x, y = _neighbours(df, [c for c, _ in keys], position)
    wrong = F.lit(strict)
    for i, (_, ascending) in reversed(list(enumerate(keys))):
        a, b = F.col(f"x{i}"), F.col(f"y{i}")
        less = F.when(a.isNull(), b.isNotNull()).when(b.isNull(), False).otherwise(a < b)
        wrong = F.when(a.eqNullSafe(b), wrong).otherwise(~less if ascending else less)
    return x.join(y, "__p").where(wrong).select(F.col("__at").alias(position))


def no_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def support(groups: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The groups are the different keys of the rows, each once."""
    seen = rows.groupBy(*keys).agg(F.lit(1).alias("n")).select(*keys, F.lit(0).cast("long").alias("g"), F.lit(1).cast("long").alias("r"))
    made = groups.select(*keys, F.lit(1).cast("long").alias("g"), F.lit(0).cast("long").alias("r"))
    return made.union(seen).groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("r").alias("r")).where("g <> r")


def rematerialized(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """The same active rows, and a mask that is true or false."""
    return permutation(before.where(F.col(ACTIVE)).select(*columns), after.where(F.col(ACTIVE)).select(*columns)).select(F.lit("rows").alias("what")).union(boolean(after, ACTIVE).select(F.lit("mask")))


def match_pairs(left: DataFrame, right: DataFrame, output: DataFrame, on: list[tuple[str, str]], out_keys: list[str]) -> DataFrame:
    """For every key the output has as many rows as both sides' counts multiply to."""
    keys = [f"k{i}" for i in range(len(on))]
    counted = lambda df, columns, name: df.select(*[F.col(c).alias(k) for c, k in zip(columns, keys, strict=True)]).dropna().groupBy(*keys).agg(F.count("*").alias(name))
    want = counted(left, [a for a, _ in on], "l").join(counted(right, [b for _, b in on], "r"), keys).select(*keys, (F.col("l") * F.col("r")).alias("want"))
    return want.join(counted(output, out_keys, "got"), keys, "full").where(~F.col("want").eqNullSafe(F.col("got")))


def provenance(output: DataFrame, source: DataFrame, source_id: str, columns: list[str]) -> DataFrame:
    """Every output row's part from ``source`` stands there under the id it names."""
    x, y = output.select(F.col(source_id).alias(ROW_ID), *columns).alias("a"), source.select(ROW_ID, *columns).alias("b")
    return x.join(y, _same("a", "b", [ROW_ID, *columns]), "left_anti")


def limit_check(before: DataFrame, after: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The rows still active are the wanted stretch of those active before, by row id."""
    want = before.where(F.col(ACTIVE)).select(ROW_ID).orderBy(ROW_ID).offset(offset).limit(n)
    return permutation(want, after.where(F.col(ACTIVE)).select(ROW_ID))


def extremes(rows: DataFrame, groups: DataFrame, keys: list[str], value: str, bound: str, lowest: bool = True) -> DataFrame:
    """A group's minimum (or maximum) bounds all its values and is one of them."""
    best = (F.min if lowest else F.max)(value)
    x, y = rows.groupBy(*keys).agg(best.alias("__best")).alias("a"), groups.select(*keys, bound).alias("b")
    return y.join(x, _same("a", "b", keys), "left").where(~F.col("__best").eqNullSafe(F.col(f"b.`{bound}`"))).select("b.*")


def folded(df: DataFrame, columns: list[str], out: str = "fold") -> DataFrame:
    """One value that stands for several columns: their SHA-256 with nulls and lengths kept apart."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return df.withColumn(out, F.sha2(F.concat_ws("|", *[part(c) for c in columns]), 256))


def ties(df: DataFrame, keys: list[str], position: str = ROW_ID) -> DataFrame:
    """(position, keys, tie): whether each row's keys equal those of the row right before it."""
    x, y = _neighbours(df, keys, position)
    same = reduce(lambda a, b: a & b, [F.col(f"x{i}").eqNullSafe(F.col(f"y{i}")) for i in range(len(keys))])
    told = x.join(y, "__p").select(F.col("__next").alias("__at"), same.alias("tie"))
    return x.join(told, "__at", "left").select(F.col("__at").alias(position), *[F.col(f"x{i}").alias(c) for i, c in enumerate(keys)], F.coalesce("tie", F.lit(False)).alias("tie"))
