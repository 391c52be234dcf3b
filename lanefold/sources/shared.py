"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it again: the table outlives any executor, is columnar, and costs one write.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; in local mode without the setting, a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own_dir:
        own = tempfile.mkdtemp(prefix="lanefold-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dir[app] = f"file://{own}"
    return _own_dir[app]


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/lanefold/{spark.sparkContext.applicationId}"


def place(spark: SparkSession, tag: str) -> str:
    """A fresh path in the application's folder."""
    return f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Deletes the application's intermediate tables; results that have not been written or collected by then can't be read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df below the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = place(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given Parquet tables, read with its own schema."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
