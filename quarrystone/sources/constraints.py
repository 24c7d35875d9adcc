"""Key constraints of tables, kept in a JSON file beside them and in column metadata."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import holds, lookup, no_duplicates
from ..operators.joinmode import Keys

FILE, FORMAT = "constraints.json", 1


@dataclass
class ForeignKey:
    columns: list[str]
    ref_table: str
    ref_columns: list[str]


@dataclass
class TableKeys:
    table: str
    primary_key: list[str] = field(default_factory=list)
    unique_keys: list[list[str]] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    def keys(self, filtered: bool = False) -> Keys:
        unique = [self.primary_key, *self.unique_keys] if self.primary_key else self.unique_keys
        foreign = tuple((tuple(f.columns), f.ref_table, tuple(f.ref_columns)) for f in self.foreign_keys)
        return Keys(self.table, tuple(frozenset(u) for u in unique), foreign, filtered)


def _one(table: str, pk: str | None, *fks: tuple[str, str, str]) -> TableKeys:
    return TableKeys(table, [pk] if pk else [], [], [ForeignKey([c], t, [r]) for c, t, r in fks])


#: The star schema at hand. lineitem has no primary key: order and line number repeat there.
STAR = [
    _one("region", "r_regionkey"),
    _one("nation", "n_nationkey", ("n_regionkey", "region", "r_regionkey")),
    _one("part", "p_partkey"),
    _one("supplier", "s_suppkey", ("s_nationkey", "nation", "n_nationkey")),
    _one("customer", "c_custkey", ("c_nationkey", "nation", "n_nationkey")),
    _one("orders", "o_orderkey", ("o_custkey", "customer", "c_custkey")),
    _one("lineitem", None, ("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")),
]


def dump(tables: list[TableKeys], source: str = "") -> str:
    return json.dumps({"format_version": FORMAT, "source": source, "tables": [asdict(t) for t in tables]}, indent=1)


def parse(text: str) -> dict[str, TableKeys]:
    got = json.loads(text)
    if got.get("format_version") != FORMAT:
        raise ValueError(f"constraints of format {got.get('format_version')} cannot be read")
    return {t["table"]: TableKeys(t["table"], t["primary_key"], t["unique_keys"], [ForeignKey(**f) for f in t["foreign_keys"]]) for t in got["tables"]}


def beside(spark: SparkSession, table_path: str) -> dict[str, TableKeys]:
    """The constraints in the folder of a table; none if there is no file."""
    folder = table_path.rstrip("/").rpartition("/")[0]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{FILE}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    return parse("\n".join(r[0] for r in spark.read.text(f"{folder}/{FILE}", wholetext=True).collect()))


def attach(df: DataFrame, keys: TableKeys) -> DataFrame:
    """Note the keys in the metadata of the columns."""
    notes: dict[str, dict] = {c: {"table": keys.table} for c in df.columns}
    for c in keys.primary_key:
        notes[c]["pk"] = True
    for f in keys.foreign_keys:
        for c in f.columns:
            notes[c] |= {"fk_table": f.ref_table, "fk_columns": f.ref_columns}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=notes[c]) for c in df.columns])


def broken(keys: TableKeys, tables: dict[str, DataFrame]) -> list[str]:
    """Declared constraints that the data does not keep."""
    df, out = tables[keys.table], []
    for unique in [keys.primary_key, *keys.unique_keys]:
        if unique and not holds(no_duplicates(df, unique)):
            out.append(f"{keys.table}({', '.join(unique)}) is not unique")
    for f in keys.foreign_keys:
        if f.ref_table in tables:
            ref = tables[f.ref_table].select(*[F.col(r).alias(c) for c, r in zip(f.columns, f.ref_columns, strict=True)])
            if not holds(lookup(df.dropna(subset=f.columns), ref, f.columns)):
                out.append(f"{keys.table}({', '.join(f.columns)}) has values that {f.ref_table} has not")
    return out
