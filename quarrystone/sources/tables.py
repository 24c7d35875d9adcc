"""Reading and registering Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..names import ACTIVE, SYSTEM, data_columns


def stem(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].removesuffix(".parquet")


def expand(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Table name -> path. A path that ends in .parquet is a table; any other is a folder of such, taken in order.

    Listing goes through Spark's file systems, so any store it reads will do.
    A name that occurs twice, and a folder without tables, are errors.
    """
    jvm, found = spark.sparkContext._jvm, {}
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(path)
        if path.rstrip("/").endswith(".parquet"):
            names = [path.rstrip("/")]
        else:
            names = sorted(f"{path.rstrip('/')}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet"))
            if not names:
                raise FileNotFoundError(f"no Parquet table in {path}")
        for name in names:
            if stem(name) in found:
                raise ValueError(f"two tables are called {stem(name)}")
            found[stem(name)] = name
    return found


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def active(df: DataFrame) -> DataFrame:
    """The active rows of a normalised table, without system columns; any other table as it is."""
    return df.where(ACTIVE).select(*[f"`{c}`" for c in data_columns(df.columns)]) if set(SYSTEM) <= set(df.columns) else df


def register(spark: SparkSession, paths: list[str], keep_system: bool = False) -> dict[str, DataFrame]:
    """Temporary views named after the tables; masked tables show their active rows unless ``keep_system``."""
    frames = {}
    for name, path in expand(spark, paths).items():
        df = scan(spark, path)
        frames[name] = df if keep_system else active(df)
        frames[name].createOrReplaceTempView(name)
    return frames


def schema_only(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """An empty table of a known schema under its name, for planning without data."""
    df = spark.createDataFrame([], schema)
    df.createOrReplaceTempView(name)
    return df


def write(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").options(**options).format(kind).save(path)
