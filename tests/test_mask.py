"""compact(op(t)) holds the same rows as the plain operator on compact(t)."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import prep
from quarrystone.names import ACTIVE, ROW_ID
from quarrystone.operators import mask


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=[0, 1, 2, 3])
def t(spark, request):
    rng = random.Random(request.param)
    n = [0, 1, 9, 40][request.param]
    data = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), rng.random() < 0.7) for i in range(n)]
    df = spark.createDataFrame(data, f"`{ROW_ID}` long, k string, v int, `{ACTIVE}` boolean").select("k", "v", ROW_ID, ACTIVE)
    return df


def test_filter(t):
    got = mask.filter_rows(t, F.col("v") > 1)
    assert got.count() == t.count()
    assert rows(mask.compact(got)) == rows(mask.compact(t).where("v > 1"))


def test_limit(t):
    got = mask.compact(mask.limit(t, 5, 2))
    assert rows(got) == rows(t.where(ACTIVE).orderBy(ROW_ID).offset(2).limit(5).select("k", "v"))


def test_aggregate(t):
    masked = mask.aggregate(t, ["k"], n=F.count("*"), s=F.sum("v"))
    assert masked.count() == t.count()
    assert rows(mask.compact(masked)) == rows(mask.compact(t).groupBy("k").agg(F.count("*"), F.sum("v")))


def test_global_aggregate_stands_on_the_first_active_row(t):
    got = mask.aggregate(t, [], n=F.count("*"))
    active = t.where(ACTIVE).count()
    assert mask.compact(got).collect() == ([(active,)] if active else [])


def test_sort(t):
    got = [tuple(r) for r in mask.sort(t, F.col("v").asc_nulls_last()).collect()]
    assert got == sorted(got, key=lambda r: (not r[3], r[1] is None, r[1] or 0, r[2]))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_many(t, how):
    other = t.select(F.col("k").alias("k2"), F.col("v").alias("v2"), ROW_ID, ACTIVE)
    got = mask.join_many(t, other, [("k", "k2")], how)
    plain = mask.compact(t).join(mask.compact(other), F.col("k") == F.col("k2"), how)
    assert rows(mask.compact(got)) == rows(plain)
    assert sorted(r[0] for r in got.select(ROW_ID).collect()) == list(range(plain.count()))


def test_join_key(spark, t):
    pk = spark.createDataFrame([("a", 10, 0, True), ("b", 20, 1, False)], f"k2 string, w int, `{ROW_ID}` long, `{ACTIVE}` boolean")
    got = mask.join_key(t, pk, [("k", "k2")])
    assert got.count() == t.count()
    assert rows(mask.compact(got)) == rows(mask.compact(t).join(mask.compact(pk), F.col("k") == F.col("k2")))


def test_join_key_refuses_duplicates(spark, t):
    pk = spark.createDataFrame([("a", 0, True), ("a", 1, True)], f"k2 string, `{ROW_ID}` long, `{ACTIVE}` boolean")
    with pytest.raises(ValueError):
        mask.join_key(t, pk, [("k", "k2")])


def test_rematerialize(t):
    got = mask.rematerialize(t)
    assert rows(mask.compact(got)) == rows(mask.compact(t))
    n = t.where(ACTIVE).count()
    assert got.count() == (1 << (n - 1).bit_length() if n else 0)


def test_preprocess_then_mask(spark):
    df = prep.preprocess(spark.range(5).toDF("x"))
    assert mask.compact(mask.filter_rows(df, F.col("x") >= 3)).count() == 2
