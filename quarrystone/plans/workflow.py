"""The roles and their steps over files: set up, commit, prove, verify, query."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.prep import preprocess
from ..sources.tables import expand, register, stem
from . import graph
from .certify import Certificate, Report, prove, verify
from .commit import Manifest, ManifestCache, listing
from .rules import Rules


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """To any store that Spark writes."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


class Stats:
    """Timings of steps, a JSON object a line."""

    def __init__(self, sink: Callable[[str], None] | None = None):
        self.sink, self.rows = sink, []

    def timed(self, step: str, run: Callable, **more):
        began = time.perf_counter()
        out = run()
        self.rows.append({"step": step, "seconds": round(time.perf_counter() - began, 4), **more})
        if self.sink:
            self.sink(json.dumps(self.rows[-1]))
        return out


@dataclass
class Workspace:
    """A folder for manifests, results and certificates; a table whose files stay the same is hashed once in a session."""

    spark: SparkSession
    folder: str
    stats: Stats = field(default_factory=Stats)
    cache: ManifestCache = field(default_factory=ManifestCache)
    rules: Rules = field(default_factory=Rules)

    def setup(self) -> None:
        write_text(self.spark, f"{self.folder}/workspace.json", json.dumps({"format_version": 1, "engine": self.spark.version}))

    def commit(self, path: str, key: list[str] | None = None) -> Manifest:
        made = self.stats.timed("commit", lambda: self.cache.get(self.spark, path, key), table=stem(path))
        write_text(self.spark, f"{self.folder}/{made.table}.commitment.json", made.to_json())
        write_text(self.spark, f"{self.folder}/{made.table}.files.json", json.dumps(listing(self.spark, path)))
        self.stats.rows[-1] |= {"rows": made.rows, "columns": len(made.columns)}
        return made

    def manifest(self, table: str) -> Manifest:
        return Manifest.from_json(read_text(self.spark, f"{self.folder}/{table}.commitment.json"))

    def stale(self, path: str) -> bool:
        """Whether a table has no commitment, or its files are others than those committed."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{stem(path)}.files.json")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return True
        return json.loads(read_text(self.spark, f"{self.folder}/{stem(path)}.files.json")) != listing(self.spark, path)

    def prove(self, sql: str, paths: list[str], name: str = "answer", applied: list[dict] | None = None) -> Certificate:
        tables = list(expand(self.spark, paths).values())
        manifests = [self.manifest(stem(p)) for p in tables]
        made = self.stats.timed("prove", lambda: prove(self.spark, sql, tables, manifests, f"{self.folder}/{name}.result.parquet", applied, self.rules))
        text = made.to_json()
        write_text(self.spark, f"{self.folder}/{name}.certificate.json", text)
        self.stats.rows[-1] |= {"rows": made.rows, "certificate_bytes": len(text), "plan": made.plan}
        return made

    def verify(self, sql: str, paths: list[str], name: str = "answer", result_path: str | None = None, fresh: bool = True) -> Report:
        """Check a certificate. With ``fresh`` off, tables whose files have not changed since this session hashed them are not hashed again."""
        tables = list(expand(self.spark, paths).values())
        certificate = Certificate.from_json(read_text(self.spark, f"{self.folder}/{name}.certificate.json"))
        result = self.spark.read.parquet(result_path or f"{self.folder}/{name}.result.parquet")
        recommit = None if fresh else lambda p, key: self.cache.get(self.spark, p, key)
        return self.stats.timed("verify", lambda: verify(self.spark, sql, tables, [self.manifest(stem(p)) for p in tables], certificate, result, recommit))

    def prove_and_verify(self, sql: str, paths: list[str], name: str = "answer") -> Report:
        """All steps in one call; commitments that are missing or stale are made anew."""
        for p in expand(self.spark, paths).values():
            if self.stale(p):
                self.commit(p)
        self.prove(sql, paths, name)
        return self.verify(sql, paths, name, fresh=False)


def query(spark: SparkSession, sql: str, paths: list[str], dot: bool = False) -> DataFrame | str:
    register(spark, paths)
    found = spark.sql(sql)
    return graph.graphviz(found) if dot else found


def prepare(spark: SparkSession, path: str, out: str, key: list[str] | None = None, **how) -> None:
    preprocess(spark.read.parquet(path), key, **how).write.mode("overwrite").parquet(out)
