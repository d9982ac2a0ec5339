"""Intermediate tables in the folder that every executor shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``.  The setting is read from the session; only where it
is unset and Spark runs in one process (unit tests, notebooks) is a local folder made and set.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder, else a new local one."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="readmerge-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/readmerge-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rpartition("/")[0]))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like :func:`materialize`, with rows in buckets of ``column``: a join on it by as many partitions leaves them in place."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"readmerge_{uuid.uuid4().hex}"
    df.write.option("path", path).bucketBy(buckets, column).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out.scratch_path = path
    _tables.append((spark, table))
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`materialize` from which nothing is left to be computed."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, table in _tables:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # as below
                spark.sql(f"DROP TABLE IF EXISTS {table}")
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may have gone first; the files are then left to the cluster's own cleaning
                _delete(spark, path)
