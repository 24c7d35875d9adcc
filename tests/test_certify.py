"""Commit, prove, verify; and every tampering is found."""

import pytest
from pyspark.sql import functions as F

from quarrystone import cli
from quarrystone.plans import graph, workflow
from quarrystone.plans.commit import ManifestCache, commit, commit_path, find
from quarrystone.plans.workflow import Workspace, prepare, query
from quarrystone.sources.tables import expand, register

SQL = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey LIMIT 50"


@pytest.fixture(scope="module")
def space(spark, sf_dir, tmp_path_factory):
    w = Workspace(spark, str(tmp_path_factory.mktemp("space")))
    w.setup()
    path = f"{w.folder}/lineitem.parquet"
    prepare(spark, f"{sf_dir}/lineitem.parquet", path)
    w.commit(path)
    w.prove(SQL.replace(" ORDER BY l_orderkey LIMIT 50", ""), [path])
    return w, path, SQL.replace(" ORDER BY l_orderkey LIMIT 50", "")


def test_honest(space):
    w, path, sql = space
    report = w.verify(sql, [path])
    assert report.ok, report.checks
    assert {r["step"] for r in w.stats.rows} >= {"commit", "prove"}


@pytest.mark.parametrize("how", ["cell", "dropped", "doubled"])
def test_tampered_result(space, tmp_path, how):
    w, path, sql = space
    result = w.spark.read.parquet(f"{w.folder}/answer.result.parquet")
    first = result.orderBy(*result.columns).limit(1)
    one = tuple(first.first())
    if how == "cell":
        bad = result.withColumn("l_quantity", F.when(F.col("l_orderkey") == one[0], F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast(result.schema["l_quantity"].dataType))
    else:
        bad = result.exceptAll(first) if how == "dropped" else result.union(first)
    bad.write.parquet(f"{tmp_path}/bad")
    report = w.verify(sql, [path], result_path=f"{tmp_path}/bad")
    assert not report.checks["result"] and not report.checks["result digest"]


def test_reordered_result_passes(space, tmp_path):
    w, path, sql = space
    w.spark.read.parquet(f"{w.folder}/answer.result.parquet").orderBy(F.desc("l_orderkey")).write.parquet(f"{tmp_path}/r")
    assert w.verify(sql, [path], result_path=f"{tmp_path}/r").ok


def test_other_query(space):
    w, path, sql = space
    report = w.verify(sql.replace("'R'", "'A'"), [path])
    assert not report.checks["query"] and not report.ok


def test_changed_table(spark, space, tmp_path):
    w, path, sql = space
    t = spark.read.parquet(path)
    t.withColumn("l_tax", F.when(F.col("l_orderkey") == 7, F.col("l_tax") + 1).otherwise(F.col("l_tax")).cast(t.schema["l_tax"].dataType)).write.parquet(f"{tmp_path}/lineitem.parquet")
    report = w.verify(sql, [f"{tmp_path}/lineitem.parquet"])
    assert not report.checks["data of lineitem"]


def test_roots_bind_to_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, y string")
    a = commit(df, "t")
    assert a == commit(df.repartition(3), "t") and a.rows == 3 and a.log_size == 2
    assert a.root != commit(df.where("x < 3"), "t").root
    swapped = df.select(F.col("y").alias("x2"), "x")
    assert a.root != commit(swapped, "t").root
    assert a.columns["x"] == commit(df.withColumn("y", F.lit("q")), "t").columns["x"]
    assert commit(df.limit(0), "e").rows == 0


def test_prove_and_verify_in_one_call(spark, sf_dir, tmp_path):
    w = Workspace(spark, str(tmp_path))
    assert w.prove_and_verify("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", [f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"]).ok


def test_expand(spark, sf_dir, tmp_path):
    assert set(expand(spark, [sf_dir])) >= {"nation", "lineitem"}
    with pytest.raises(FileNotFoundError):
        expand(spark, [f"{sf_dir}/nothing.parquet"])
    with pytest.raises(FileNotFoundError):
        expand(spark, [str(tmp_path)])
    with pytest.raises(ValueError):
        expand(spark, [f"{sf_dir}/nation.parquet", sf_dir])


def test_register_shows_active_rows(spark, sf_dir, tmp_path):
    prepare(spark, f"{sf_dir}/nation.parquet", f"{tmp_path}/nation.parquet")
    register(spark, [f"{tmp_path}/nation.parquet"])
    assert spark.sql("select count(*), count(n_name) from nation").first()[:] == (25, 25)
    assert spark.read.parquet(f"{tmp_path}/nation.parquet").count() == 32


def test_cache_and_lookup(spark, sf_dir):
    cache, path = ManifestCache(), f"{sf_dir}/region.parquet"
    assert cache.get(spark, path) is cache.get(spark, path)
    m = commit_path(spark, path)
    assert find([m], "region") is m and find([m], "other", m.spark_schema()) is m
    with pytest.raises(LookupError):
        find([m], "other")


def test_graphviz(spark, sf_dir):
    dot = query(spark, "SELECT count(*) AS n FROM nation", [f"{sf_dir}/nation.parquet"], dot=True)
    assert dot.startswith("digraph") and "Aggregate" in dot and "->" in dot
    df = query(spark, "SELECT count(*) AS n FROM nation", [f"{sf_dir}/nation.parquet"])
    assert graph.plan_json(df) and len(graph.plan_hash(df)) == 64


def test_command_line(spark, sf_dir, tmp_path, capsys):
    paths = ["--parquet-path", f"{sf_dir}/nation.parquet"]
    sql = ["--query", "SELECT n_name FROM nation WHERE n_regionkey = 1"]
    space = ["--workspace", str(tmp_path)]
    assert cli.main(["setup", *space]) == 0
    assert cli.main(["commit", *space, *paths]) == 0
    assert cli.main(["--timed", "prove", *space, *paths, *sql]) == 0
    assert cli.main(["verify", *space, *paths, *sql]) == 0
    assert cli.main(["query", *paths, *sql]) == 0
    assert cli.main(["query", *paths, "--query", "SELECT 1 AS x FROM nation WHERE false"]) == 0
    assert "Query returned 0 rows." in capsys.readouterr().out
    assert cli.main(["data-prep", *paths, "--output", f"{tmp_path}/nation.parquet"]) == 0


def test_hints_are_applied_and_checked(spark, sf_dir, tmp_path):
    """A masked table with few active rows is compacted before the query; a hint that would lose rows is refused."""
    space = Workspace(spark, str(tmp_path))
    from quarrystone.functions.prep import preprocess
    from quarrystone.operators.mask import filter_rows

    t = filter_rows(preprocess(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"]), F.col("o_orderstatus") == "P")
    t.write.parquet(f"{tmp_path}/orders.parquet")
    path, sql = f"{tmp_path}/orders.parquet", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders"
    assert space.stale(path)
    assert space.prove_and_verify(sql, [path]).ok and not space.stale(path)
    made = space.prove(sql, [path])
    assert [(h["path"], h["hint"]) for h in made.hints] == [("orders", "rematerialize")]
    plain = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'P'").count()
    assert spark.read.parquet(f"{tmp_path}/answer.result.parquet").first()["n"] == plain
    space.prove(sql, [path], "cut", [{"path": "orders", "hint": "truncate"}])
    report = space.verify(sql, [path], "cut", fresh=False)
    assert not report.checks["hints"] and not report.ok
    assert len([r for r in space.stats.rows if r["step"] == "commit"]) == 1 and {"rows", "columns"} <= set(space.stats.rows[0])


def test_commit_by_key_verifies(spark, tmp_path):
    spark.createDataFrame([(3, "a"), (1, "c"), (2, "b")], "x int, y string").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    space = Workspace(spark, f"{tmp_path}/space")
    made = space.commit(f"{tmp_path}/t.parquet", ["y"])
    assert made.key == ["y"] and made.root != commit_path(spark, f"{tmp_path}/t.parquet").root
    space.prove("SELECT max(x) AS m FROM t", [f"{tmp_path}/t.parquet"])
    assert space.verify("SELECT max(x) AS m FROM t", [f"{tmp_path}/t.parquet"]).ok


def test_a_tree_of_three_levels(spark, monkeypatch):
    from quarrystone.plans import commit as module

    monkeypatch.setattr(module, "FAN", 4)
    df = spark.range(50).select(F.col("id").alias("x"))
    a = commit(df, "t")
    assert a == commit(df.repartition(7), "t") and a.root != commit(df.where("x <> 20"), "t").root
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = [sha(f"={i}") for i in range(50)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
    assert a.columns["x"] == level[0]


@pytest.mark.parametrize("rows", [1, 4, 5, 16, 17, 50])
def test_a_flat_root_is_over_all_leaves(spark, monkeypatch, rows):
    import hashlib

    from quarrystone.plans import commit as module

    monkeypatch.setattr(module, "FAN", 4)
    x = [None if i % 7 == 3 else i for i in range(rows)]
    df = spark.createDataFrame([(i, v, i % 3 > 0) for i, v in enumerate(x)], f"{module.ROW_ID} long, x long, {module.ACTIVE} boolean").repartition(7)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cells = [sha("-" if v is None else f"={v}") for v in x]
    leaves = [sha("".join(cells[i : i + 4])) for i in range(0, rows, 4)]
    got, active = module._tree(df, rows, flat=True)
    assert got["x"] == (leaves[0] if len(leaves) == 1 else sha("".join(leaves)))
    assert active == sum(i % 3 > 0 for i in range(rows)) and got == module.digests(df, flat=True)
    assert (got == module.digests(df)) == (rows <= 16)


def test_clusters_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quarrystone import session

    none = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_rules_are_recorded_and_checked(spark, sf_dir, tmp_path):
    from quarrystone.plans.rules import Rules

    rules = Rules().without("ConstantFolding").set("spark.sql.autoBroadcastJoinThreshold", "-1").without("PushDownPredicates")
    space, path, sql = Workspace(spark, str(tmp_path), rules=rules), f"{sf_dir}/nation.parquet", "SELECT count(*) + (1 + 2) AS n FROM nation WHERE n_regionkey = 1 + 1"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    space.commit(path)
    made = space.prove(sql, [path])
    assert made.rules == rules.settings and made.rules["spark.sql.optimizer.excludedRules"].count("optimizer") == 2
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before and spark.conf.get("spark.sql.optimizer.excludedRules", None) is None
    plain = Workspace(spark, str(tmp_path))
    assert plain.verify(sql, [path]).ok, "a checker plans with the rules of the certificate"
    assert plain.prove(sql, [path], "plain").plan != made.plan
    with pytest.raises(ValueError):
        rules.set("spark.sql.ansi.enabled", "false")
    made.rules["spark.sql.ansi.enabled"] = "false"
    workflow.write_text(spark, f"{tmp_path}/answer.certificate.json", made.to_json())
    assert plain.verify(sql, [path]).checks == {"rules": False}
