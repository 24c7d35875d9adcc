import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import prep
from quarrystone.functions.types import UnsupportedType, require_committable
from quarrystone.names import ACTIVE, ROW_ID, next_power_of_two


@pytest.mark.parametrize("n,padded", [(0, 0), (1, 1), (2, 2), (3, 4), (4, 4), (5, 8), (8, 8), (6000, 8192)])
def test_padding(spark, n, padded):
    assert next_power_of_two(n) == padded
    rows = prep.preprocess(spark.range(n).toDF("k")).collect()
    assert len(rows) == padded
    assert sorted(r[ROW_ID] for r in rows) == list(range(padded))
    assert sorted(r["k"] for r in rows if r[ACTIVE]) == list(range(n))
    assert all(r["k"] is None for r in rows if not r[ACTIVE])


def test_system_columns_come_last(spark):
    df = prep.preprocess(spark.sql("select date'1998-09-02' as d, 1 as x"))
    assert df.columns == ["d", "d_year", "d_month", "d_day", "x", ROW_ID, ACTIVE]
    r = df.first()
    assert (r["d_year"], r["d_month"], r["d_day"]) == (1998, 9, 2)


def test_timestamp_second_of_day(spark):
    r = prep.expand_dates(spark.sql("select timestamp_ntz'2024-01-01 00:09:58.778549' as t")).first()
    assert r["t_time"] == 598 and r["t"] == datetime.datetime(2024, 1, 1, 0, 9, 58, 778549)


@pytest.mark.parametrize("x,want", [(0.0125, "0.013"), (-0.0125, "-0.013"), (float("nan"), None), (float("inf"), None), (1e16, None), (None, None), (2.0, "2.000")])
def test_decimalize(spark, x, want):
    got = prep.decimalize(spark.createDataFrame([(x,)], "x double")).first()[0]
    assert got == (None if want is None else Decimal(want))


def test_comparison_variant(spark):
    df = spark.createDataFrame([(1.2345, Decimal("1.50")), (-1.0, Decimal("-1.00"))], "x double, d decimal(10,2)")
    assert [tuple(r) for r in prep.comparison_variant(df).collect()] == [(Decimal(1234), Decimal(150)), (None, None)]


def test_drop_null_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert prep.preprocess(df, without_nulls=True).where(ACTIVE).count() == 1
    assert prep.preprocess(df).where(ACTIVE).count() == 2


def test_raw_only_expands(spark):
    assert prep.preprocess(spark.sql("select date'2000-01-01' as d, 0.5D as x"), raw=True).columns == ["d", "d_year", "d_month", "d_day", "x"]


def test_row_ids_follow_the_key(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (None, "z"), (2, "b")], "k int, v string")
    got = prep.add_row_id(df, ["k"]).orderBy(ROW_ID).select("v").collect()
    assert [r[0] for r in got] == ["z", "a", "b", "c"]


def test_nested_columns_are_refused(spark):
    with pytest.raises(UnsupportedType):
        require_committable(spark.createDataFrame([([1.0],)], "embedding array<double>").schema)
    require_committable(spark.range(1).select(F.lit(None).alias("n"), F.lit("x").alias("s")).schema)
