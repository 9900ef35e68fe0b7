"""Session helpers: workers' import path, and tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch for a Python worker, where the session has its default of 64 MB: a task holds few batches at a time.
BATCH = "16m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it isn't installed, whatever folder the driver was started in, and bound their batches."""
    if spark.conf.get(_BATCH, None) in ("64m", "67108864", "67108864b"):
        spark.conf.set(_BATCH, BATCH)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a local one only where none is configured and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "paperloom-checkpoints")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost executor costs a reread.

    The table goes when :func:`discard` is called, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(files)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    own = shared_dir(spark).removeprefix("file:").lstrip("/")
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if own in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def listed(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A list of settings, to be broadcast: its rows are counted first, and more than ``most`` are an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a list of settings has more than {most} rows: {df.columns}")
    return F.broadcast(df)
