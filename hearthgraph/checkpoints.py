"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local mode, where the setting is missing (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hearthgraph-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """With these settings (dots written as two underscores), then the caller's again."""
    before = {}
    for name, value in values.items():
        key = name.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Written as a table in the shared folder, so later readers survive lost executors. Column names must differ.

    A table, not checkpoint(): that keeps the estimate of the rows' size, which grows with every join of a loop until
    planning stalls, where a table has its true size. Shuffle files of the written query go at once, as nothing reads
    them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        # a query takes the settings when it is made
        df.select("*").write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(table: DataFrame) -> None:
    """Delete what cut() wrote, once all that is made from it has been written."""
    jvm, sc = table.sparkSession._jvm, table.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(table._cut_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
