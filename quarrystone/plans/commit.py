"""Committing a table: a manifest of schema, size and content hashes.

Rows are hashed under their row ids, blocks of ids into a leaf, and leaves
level by level into one root, all as grouped aggregates. ``digests`` can also
give the root over all leaves at once. The manifest binds to the content of the
table; checking it means reading the data again. It is not a succinct or hiding
commitment.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prep import add_mask, row_ids
from ..functions.types import require_committable
from ..names import ACTIVE, ROW_ID, next_power_of_two
from ..sources.tables import stem

#: Children of a node: the most rows, and then hashes, that one group gathers.
FAN = 1024


@dataclass
class Manifest:
    table: str
    schema: dict
    rows: int
    active: int
    log_size: int
    root: str
    columns: dict[str, str] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)  # by which rows were numbered first

    def spark_schema(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Manifest:
        return Manifest(**json.loads(text))


def _encoded(c: Column) -> Column:
    """A value as text, null and empty kept apart."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def normalised(df: DataFrame, key: list[str] | None = None) -> tuple[DataFrame, int]:
    """With row id and mask, added if missing, and how many rows there are."""
    if ROW_ID in df.columns:
        n = df.count()
    else:
        df, n = row_ids(df, key)
    return (df if ACTIVE in df.columns else add_mask(df)), n


def digests(df: DataFrame, rows: int | None = None, flat: bool = False) -> dict[str, str]:
    """The root hash of each column, by name, over all rows in the order of their ids.

    ``flat`` has two levels for any number of rows: leaves, and a root over all
    of them. Up to ``FAN`` leaves it makes no difference.
    """
    return _tree(df, df.count() if rows is None else rows, flat)[0]


def _tree(df: DataFrame, rows: int, flat: bool = False) -> tuple[dict[str, str], int]:
    """The root hashes and how many rows are active, in one plan: as many levels as the rows need, or two.

    A group gathers its members once for all columns; members are ``FAN`` at most.
    """
    columns = [c for c in df.columns if c != ROW_ID]
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    act = F.col(ACTIVE).cast("long") if ACTIVE in columns else F.lit(1).cast("long")
    up = F.floor(F.col("at") / FAN)
    level = df.select(F.col(ROW_ID).alias("at"), act.alias("active"), *[F.sha2(_encoded(F.col(f"`{c}`")), 256).alias(n) for c, n in names.items()])
    left = rows
    while True:
        own = F.array_sort(F.collect_list(F.struct("at", *names.values())))
        level = level.groupBy(up.alias("at")).agg(F.sum("active").alias("active"), own.alias("own"))
        level = level.select("at", "active", *[F.sha2(F.array_join(F.col("own")[n], ""), 256).alias(n) for n in names.values()])
        left = -(-left // FAN)
        if flat and left > FAN:
            level = _streamed_root(level, list(names.values()))
            break
        if left <= 1:
            break
    found = level.first()
    return {c: (found[n] if found else "") for c, n in names.items()}, found["active"] if found else 0


def _streamed_root(level: DataFrame, names: list[str]) -> DataFrame:
    """One row: the hash over each column of all rows in the order of ``at``, which one task reads and does not keep."""

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, active = {n: hashlib.sha256() for n in names}, 0
        for b in batches:
            active += sum(x or 0 for x in b.column("active").to_pylist())
            for n, h in hashes.items():
                h.update("".join(b.column(n).to_pylist()).encode())
        yield pa.RecordBatch.from_pydict({"active": pa.array([active], pa.int64()), **{n: [h.hexdigest()] for n, h in hashes.items()}})

    ordered = level.repartition(1).sortWithinPartitions("at").drop("at")
    return ordered.mapInArrow(root, "active long, " + ", ".join(f"{n} string" for n in names))


def commit(df: DataFrame, table: str, key: list[str] | None = None) -> Manifest:
    """The manifest of a table; nested columns are refused."""
    require_committable(df.schema)
    full, rows = normalised(df, key)
    columns, active = _tree(full, rows)
    root = hashlib.sha256(("|".join(f"{c}:{columns[c]}" for c in sorted(columns)) + f"|{rows}").encode()).hexdigest()
    return Manifest(table, json.loads(df.schema.json()), rows, active, max(0, next_power_of_two(rows).bit_length() - 1), root, columns, list(key or []))


def commit_path(spark: SparkSession, path: str, key: list[str] | None = None) -> Manifest:
    return commit(spark.read.parquet(path), stem(path), key)


def listing(spark: SparkSession, path: str) -> list[list]:
    """[file, length, time of change] of each file of a table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted([s.getPath().toString(), s.getLen(), s.getModificationTime()] for s in fs.listStatus(at))


class ManifestCache:
    """Manifests by the files of a table, so an unchanged table is hashed once in a session."""

    def __init__(self) -> None:
        self._known: dict[tuple, Manifest] = {}

    def get(self, spark: SparkSession, path: str, key: list[str] | None = None) -> Manifest:
        own = (*map(tuple, listing(spark, path)), tuple(key or ()))
        if own not in self._known:
            self._known[own] = commit_path(spark, path, key)
        return self._known[own]


def find(manifests: list[Manifest], table: str, schema: T.StructType | None = None) -> Manifest:
    """By name; else the only one of the same schema."""
    named = [m for m in manifests if m.table == table]
    if not named and schema is not None:
        named = [m for m in manifests if m.schema == json.loads(schema.json())]
    if len(named) != 1:
        raise LookupError(f"{len(named)} commitments fit {table}")
    return named[0]
