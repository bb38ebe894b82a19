"""A folder for intermediate tables that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_by_call.get() if set_by_call.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/loomspan/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_FOLDERS: dict[str, str] = {}


def own_path(spark: SparkSession, label: str) -> str:
    """As new_path, in a folder of this driver that goes when Python ends, if Spark still runs then."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = folder = new_path(spark, f"tables-{app}")

        def clear() -> None:
            with contextlib.suppress(Exception):  # a stopped session has nothing to delete with
                delete(spark, folder)

        atexit.register(clear)
    return f"{_FOLDERS[app]}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: what reads it several times computes it once, also after executors were lost."""
    path = own_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)
