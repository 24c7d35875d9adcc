import pytest
from pyspark.sql import functions as F

from quarrystone.names import ACTIVE, ROW_ID
from quarrystone.operators import checks, joinmode
from quarrystone.plans import hints
from quarrystone.sources import constraints


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(i, i // 2, float(i)) for i in range(8)], f"`{ROW_ID}` long, k int, v double")


def test_sorted(spark, t):
    assert checks.holds(checks.sorted_rows(t, [("k", True), ("v", True)]))
    assert not checks.holds(checks.sorted_rows(t, [("k", True)], strict=True))
    assert not checks.holds(checks.sorted_rows(t, [("k", False)]))
    nulls = spark.createDataFrame([(0, None), (1, 1), (2, None)], f"`{ROW_ID}` long, k int")
    assert [r[0] for r in checks.sorted_rows(nulls, [("k", True)]).collect()] == [1]


def test_rows_without_a_partner_violate(t):
    assert checks.holds(checks.equal(t, t, ["k", "v"])) and checks.holds(checks.unequal(t, t.withColumn("v", F.col("v") + 1), ["v"]))
    assert [r[0] for r in checks.equal(t, t.where("k <> 3 or v <> 6"), ["k"]).collect()] == [6]
    assert checks.unequal(t, t.limit(0), ["k"]).count() == 8 and checks.equal(t.limit(0), t, ["k"]).count() == 8


def test_sorted_with_gaps(t):
    apart = t.where(F.col(ROW_ID) % 3 == 0)
    assert checks.holds(checks.sorted_rows(apart, [("v", True)])) and [r[0] for r in checks.sorted_rows(apart, [("v", False)]).orderBy(ROW_ID).collect()] == [0, 3]


def test_ties_are_between_neighbours(spark):
    df = spark.createDataFrame([(0, "a"), (2, "b"), (5, "a"), (7, "a"), (9, None), (11, None)], f"`{ROW_ID}` long, k string")
    assert [r["tie"] for r in checks.ties(df, ["k"]).orderBy(ROW_ID).collect()] == [False, False, False, True, False, True]


def test_multisets(t):
    twice = t.union(t)
    assert checks.holds(checks.permutation(t, t.orderBy(F.desc("v"))))
    assert not checks.holds(checks.permutation(t, twice))
    assert checks.holds(checks.keyed_sum(twice, t, ["k"], weight_b=F.lit(2).cast("long")))


def test_lookup_and_support(spark, t):
    some = spark.createDataFrame([(0,), (9,), (None,)], "k int")
    assert sorted(r[0] for r in checks.lookup(some, t, ["k"]).collect() if r[0] is not None) == [9]
    assert checks.holds(checks.support(t.select("k").distinct(), t, ["k"]))
    assert not checks.holds(checks.support(t.select("k"), t, ["k"]))


def test_signs_and_order(t):
    assert checks.holds(checks.sign(t, v="non_negative"))
    assert checks.sign(t, v="positive").count() == 1
    assert checks.holds(checks.at_least(t, "v", "k")) and not checks.holds(checks.at_most(t, "v", "k"))


def test_shift(t):
    moved = t.withColumn(ROW_ID, F.pmod(F.col(ROW_ID) - 1, F.lit(8)))
    assert checks.holds(checks.cyclic_shift(t, moved, 8, ["k", "v"]))
    assert not checks.holds(checks.cyclic_shift(t, t, 8, ["k", "v"]))


def test_ties(t):
    assert [r["tie"] for r in checks.ties(t, ["k"]).orderBy(ROW_ID).collect()] == [False, True] * 4


def test_fold_tells_nulls_and_borders_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc")], "x string, y string")
    assert checks.folded(df, ["x", "y"]).select("fold").distinct().count() == 4


STAR = {t.table: t.keys() for t in constraints.STAR}


@pytest.mark.parametrize(
    "left,right,on,how,residual,want",
    [
        ("orders", "customer", [("o_custkey", "c_custkey")], "inner", False, joinmode.MANY_TO_ONE),
        ("customer", "orders", [("c_custkey", "o_custkey")], "inner", False, joinmode.ONE_TO_MANY),
        ("customer", "orders", [("c_custkey", "o_custkey")], "left", False, joinmode.MANY_TO_MANY),
        ("orders", "customer", [("o_custkey", "c_custkey")], "inner", True, joinmode.MANY_TO_MANY),
        ("customer", "supplier", [("c_custkey", "s_suppkey")], "inner", False, joinmode.ONE_TO_ONE),
        ("lineitem", "lineitem", [("l_orderkey", "l_orderkey")], "inner", False, joinmode.MANY_TO_MANY),
        ("orders", "customer", [], "inner", False, joinmode.MANY_TO_MANY),
    ],
)
def test_join_mode(left, right, on, how, residual, want):
    assert joinmode.join_mode(STAR[left], STAR[right], on, how, residual) == want


def test_a_filtered_key_side_is_many_to_many():
    keys = next(t for t in constraints.STAR if t.table == "customer").keys(filtered=True)
    assert joinmode.join_mode(STAR["orders"], keys, [("o_custkey", "c_custkey")]) == joinmode.MANY_TO_MANY


def test_constraints_round_trip_and_hold(spark, sf_dir, tmp_path):
    text = constraints.dump(constraints.STAR, "test")
    assert constraints.parse(text)["orders"].primary_key == ["o_orderkey"]
    (tmp_path / constraints.FILE).write_text(text)
    assert set(constraints.beside(spark, f"file://{tmp_path}/orders.parquet")) == {t.table for t in constraints.STAR}
    tables = {t.table: spark.read.parquet(f"{sf_dir}/{t.table}.parquet") for t in constraints.STAR}
    assert [b for t in constraints.STAR for b in constraints.broken(t, tables)] == []
    wrong = constraints.TableKeys("lineitem", ["l_orderkey", "l_linenumber"])
    assert constraints.broken(wrong, tables)
    noted = constraints.attach(tables["orders"], constraints.parse(text)["orders"])
    assert noted.schema["o_orderkey"].metadata["pk"] and noted.schema["o_custkey"].metadata["fk_table"] == "customer"


def test_hints(spark):
    df = spark.range(16).select(F.col("id").alias("x"), F.col("id").alias(ROW_ID), (F.col("id") < 3).alias(ACTIVE))
    found = hints.suggest({"filter": df, "root": df}, under_check=("root",))
    assert [h["path"] for h in found] == ["filter"]
    assert hints.apply(df, "filter", found).count() == 4
    none = df.withColumn(ACTIVE, F.lit(False))
    assert hints.suggest({"f": none}, truncate=True)[0]["hint"] == hints.TRUNCATE
