"""Proving and verifying answers.

A certificate holds the query, the roots of the tables it read, the engine and
a hash of the plan, the recorded hints, and the digest of the result. Checking
it reads the committed data again: roots are recomputed, the query is replayed,
and the claimed result must be the same multiset of rows. This shows that an
answer belongs to a committed snapshot; it is neither succinct nor
zero-knowledge.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import SYSTEM
from ..operators.checks import holds, permutation
from ..sources.tables import active, schema_only, stem
from . import graph, hints
from .commit import Manifest, commit_path, find
from .rules import Rules


@dataclass
class Certificate:
    sql: str
    engine: str
    plan: str
    tables: dict[str, str]
    rows: int
    result: str
    schema: dict
    hints: list[dict] = field(default_factory=list)
    rules: dict[str, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Certificate:
        return Certificate(**json.loads(text))


@dataclass
class Report:
    checks: dict[str, bool]

    @property
    def ok(self) -> bool:
        return all(self.checks.values())


def multiset_digest(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order: sums of five parts of each row's SHA-256, 48 bits each."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]), 256)
    # Sums are taken in halves of 24 bits, which do not overflow under 2^39 rows.
    part = lambda i: F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("long")
    sums = [F.sum(half(F.col(f"p{i}"))) for i in range(5) for half in (lambda c: F.shiftright(c, 24), lambda c: c.bitwiseAND(F.lit((1 << 24) - 1)))]
    r = df.select(row.alias("h")).select(*[part(i).alias(f"p{i}") for i in range(5)]).agg(F.count("*").alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
    total = [(r[f"s{2 * i}"] or 0) * (1 << 24) + (r[f"s{2 * i + 1}"] or 0) for i in range(5)]
    return "/".join(str(x) for x in (r["n"], *total))


def _masked(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    read = {stem(p): spark.read.parquet(p) for p in paths}
    return {name: df for name, df in read.items() if set(SYSTEM) <= set(df.columns)}


def _views(spark: SparkSession, paths: list[str], applied: list[dict]) -> None:
    """The active rows of each table under its name; hints say which masked tables are compacted or cut off first."""
    masked = _masked(spark, paths)
    for p in paths:
        name = stem(p)
        df = hints.apply(masked[name], name, applied) if name in masked else spark.read.parquet(p)
        active(df).createOrReplaceTempView(name)


def plan_of(spark: SparkSession, sql: str, manifests: list[Manifest]) -> str:
    """The hash of the plan over empty tables of the committed schemas, as no data is needed to plan."""
    for m in manifests:
        active(schema_only(spark, m.table, m.spark_schema())).createOrReplaceTempView(m.table)
    return graph.plan_hash(spark.sql(sql))


def prove(spark: SparkSession, sql: str, paths: list[str], manifests: list[Manifest], result_path: str, applied: list[dict] | None = None, rules: Rules | None = None) -> Certificate:
    """Answer ``sql`` over the active rows, write the result, and certify it.

    ``applied`` are hints by table for masked tables; if none are given, those
    that the row counts suggest are applied and recorded. ``rules`` override
    the planner's.
    """
    rules = rules or Rules()
    with rules.applied(spark):
        return _prove(spark, sql, paths, manifests, result_path, applied, rules)


def _prove(spark: SparkSession, sql: str, paths: list[str], manifests: list[Manifest], result_path: str, applied: list[dict] | None, rules: Rules) -> Certificate:
    if len(paths) != len(manifests):
        raise ValueError("one commitment is needed for each table")
    own = {stem(p): find(manifests, stem(p)) for p in paths}
    plan = plan_of(spark, sql, list(own.values()))
    if applied is None:
        applied = hints.suggest(_masked(spark, paths))
    _views(spark, paths, applied)
    spark.sql(sql).write.mode("overwrite").parquet(result_path)
    result = spark.read.parquet(result_path)
    return Certificate(sql, spark.version, plan, {t: m.root for t, m in own.items()}, result.count(), multiset_digest(result), json.loads(result.schema.json()), applied, rules.settings)


def result_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return permutation(a, b.select(*[f"`{c}`" for c in a.columns]))


def verify(spark: SparkSession, sql: str, paths: list[str], manifests: list[Manifest], certificate: Certificate, result: DataFrame, recommit: Callable[[str, list[str]], Manifest] | None = None) -> Report:
    """Every check by name; the replay runs only if the query and the tables are those certified, with the hints that are.

    ``recommit`` makes the manifest of a path and a key; by default from the data.
    """
    rules = Rules(certificate.rules)
    if not rules.sound:
        return Report({"rules": False})
    with rules.applied(spark):
        return Report({"rules": True} | _verify(spark, sql, paths, manifests, certificate, result, recommit))


def _verify(spark: SparkSession, sql: str, paths: list[str], manifests: list[Manifest], certificate: Certificate, result: DataFrame, recommit: Callable[[str, list[str]], Manifest] | None) -> dict[str, bool]:
    recommit = recommit or (lambda p, key: commit_path(spark, p, key))
    checks = {"query": certificate.sql == sql, "engine": certificate.engine == spark.version}
    own = {m.table: m for m in manifests}
    checks["tables"] = certificate.tables == {t: m.root for t, m in own.items()}
    for p in paths:
        m = own.get(stem(p))
        checks[f"data of {stem(p)}"] = m is not None and recommit(p, m.key) == m
    checks["plan"] = certificate.plan == plan_of(spark, sql, manifests)
    masked = _masked(spark, paths)
    checks["hints"] = {h["path"] for h in certificate.hints} <= set(masked) and all(hints.sound(df, name, certificate.hints) for name, df in masked.items())
    checks["result schema"] = [(f["name"], f["type"]) for f in certificate.schema["fields"]] == [(f["name"], f["type"]) for f in json.loads(result.schema.json())["fields"]]
    checks["result digest"] = certificate.result == multiset_digest(result) if checks["result schema"] else False
    if checks["query"] and checks["result schema"] and checks["hints"]:
        _views(spark, paths, certificate.hints)
        replay = spark.sql(sql)
        checks["result"] = replay.columns == result.columns and holds(result_check(replay, result))
    return checks
