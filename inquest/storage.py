"""Shared storage: where iterative jobs cut their lineage, so that a lost executor costs one step only."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: the files of a query's shuffles go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table below `sf_dir`, read through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`. Where that is unset, a local session gets a temporary one; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="inquest-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path of this name in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, replaces: tuple[DataFrame | None, ...] = ()) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there, and its size is known to later joins.

    The files of the query's shuffles go with its end, and so do the results in `replaces`, which nothing may read any
    more: long jobs do not pile up the files of all their steps.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    before = spark.conf.get(CLEANUP)  # with a default given, Spark would return that and not its own
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    discard(*replaces)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*done: DataFrame | None) -> None:
    """Deletes the files of stored results that nothing reads any more."""
    for df in done:
        if df is not None and (path := _paths.pop(df, None)):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
