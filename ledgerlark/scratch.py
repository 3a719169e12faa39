"""Where iterations write their tables: the folder that the cluster names, which driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Only where that is unset and Spark runs in this process, as in tests, a local
    folder that goes with the process: a cluster's machines share none, so there the setting is required."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="ledgerlark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    path = f"{base.rstrip('/')}/ledgerlark-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)  # results read these tables lazily, so they go when the driver ends
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the process ends: what can't be removed any more stays
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


#: Rows of a task where so many are sorted.
TASK = 1 << 18


def parts(spark: SparkSession, rows: int) -> int:
    """Parts for a shuffle of so many rows: the session's number, and more where its parts would grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK))


def store(df: DataFrame, *by: str) -> DataFrame:
    """The rows written (in a folder for each value of ``by``) and read back: an iteration's lineage ends here, and a lost
    executor repeats nothing before it. ``discard`` removes them; else they stay until the folder is cleaned."""
    path = new_folder(df.sparkSession)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._scratch_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Remove what ``store`` wrote, once nothing reads it any more."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
