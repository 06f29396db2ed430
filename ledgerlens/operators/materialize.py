"""Materialize an intermediate result in the shared checkpoint folder.

Used where one intermediate is read by several jobs. Writing it as
Parquet under the session's ``spark.checkpoint.dir`` cuts the lineage,
survives executor loss (the folder is shared storage on a cluster) and
keeps columnar pruning for the readers. Tables that are no longer needed
are removed with :func:`release`; what is left is removed when the
application's JVM ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import checkpoint_dir

# folder of each table written by this application -> its session
_WRITTEN: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name. Call :func:`remove_at_exit` once it exists."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the copy."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    remove_at_exit(spark, path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._ledgerlens_path = path
    return stored


def file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file through Spark's file system."""
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove an existing folder when the JVM shuts down."""
    fs, target = file_system(spark, path)
    fs.deleteOnExit(target)


def release(*tables: DataFrame) -> None:
    """Remove tables returned by :func:`materialize`; nothing may read
    them afterwards. Other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_ledgerlens_path", None)
        if path and path in _WRITTEN:
            delete_folder(_WRITTEN.pop(path), path)
