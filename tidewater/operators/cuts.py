"""Where a plan is computed once and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends. No setting is changed.

    Where that is unset, a temporary folder serves a local master; on a cluster it is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master is {context.master})")
            root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        _FOLDERS[app] = f"{root.rstrip('/')}/tidewater-cuts-{app}"
        path = context._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _FOLDERS[app]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, with what led to it out of the plan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df cut, in tasks of about so many rows, for work that is much for its bytes: the number of tasks grows with the rows and not with the machine."""
    kept = cut(df)
    return kept.repartition(max(1, -(-kept.count() // rows)), key)
