"""Session settings and reliable materialisation."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's, or a fresh one where none is set and all runs in one process.

    A cluster without ``spark.checkpoint.dir`` is refused, as its machines
    would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    defined = context._jsc.sc().getCheckpointDir()
    if defined.isEmpty():
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarrystone-"))
        defined = context._jsc.sc().getCheckpointDir()
    return folder or defined.get()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from any store that Spark writes; a missing one is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in storage that survives a lost executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_session(cores: int | str = "*", memory: str = "20g", partitions: int = 8) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
