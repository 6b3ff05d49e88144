"""Session settings the engine expects, for local runs and tests."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "siltworks") -> SparkSession:
    """A local session with the same settings that the benchmark and the tests use."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    own = spark.sparkContext.environment
    if root not in own.get("PYTHONPATH", "").split(":"):
        own["PYTHONPATH"] = ":".join(filter(None, [root, own.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share: spark.checkpoint.dir, or a temporary folder where a local session has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="siltworks-")
    return f"{shared}/{name}-{uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, without its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "settled"))
    return df.checkpoint(eager=True)


#: Rows that a task works on.
ROWS = 100_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """A table as read from files, dealt out by its keys in tasks of about ROWS rows.

    Columns that compress well put millions of rows in one split of a file, or in one partition of a shuffle that is
    joined by bytes. Rows are counted by the files' footers unless given.
    """
    n = -(-(df.count() if rows is None else rows) // ROWS)
    return df.repartition(n, *keys) if n > 1 else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
