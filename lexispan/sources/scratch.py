"""Tables in the folder that all executors share: they cut lineage, are read as often as wanted, and go when the process ends."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where none is named a local master gets a local one, as in tests; a cluster is refused, as its executors would write to their own disks."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(context, "_lexispan_scratch", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = context._lexispan_scratch = "file://" + tempfile.mkdtemp(prefix="lexispan-scratch-")
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
    return folder


def scratch_path(spark: SparkSession, name: str, sweep: bool = False) -> str:
    """A new path in the shared folder; with ``sweep`` what is written there goes when the process ends."""
    path = os.path.join(shared_folder(spark), f"lexispan-{name}-{uuid.uuid4().hex}")
    if sweep:
        _left(spark).append(path)
    return path


def _left(spark: SparkSession) -> list[str]:
    """Paths to be removed at the process's end."""
    left = getattr(spark.sparkContext, "_lexispan_left", None)
    if left is None:
        left = spark.sparkContext._lexispan_left = []
        atexit.register(_sweep, spark, left)
    return left


def _sweep(spark: SparkSession, paths: list[str]) -> None:
    """Remove what this process has left in the shared folder; results may read it as long as the process lives."""
    try:
        jvm, hadoop = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
    except Exception:  # the session's JVM has ended before: the folder is the cluster's to clean
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: cuts the lineage and outlives executors. It goes when the process ends, if ``discard`` has not removed it before."""
    spark = df.sparkSession
    path = scratch_path(spark, name, sweep=True)
    df.write.option("compression", "zstd" if name.endswith("z") else "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexispan_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of ``written`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_lexispan_path", None)
        if path:
            left = getattr(df.sparkSession.sparkContext, "_lexispan_left", [])
            if path in left:
                left.remove(path)
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
