"""What the operators of this subpackage share: memory given back, partitions, connected components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.session import ship  # noqa: F401  the operators take these from here
from lexispan.sources.scratch import discard, scratch_path, shared_folder, written  # noqa: F401


def release() -> None:
    """Give the memory that a task has freed back to the system: idle workers would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(f):
    """A function of Arrow batches whose worker gives its memory back at the task's end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest id that each node reaches, (node, component), for the nodes of ``edges`` (a, b) of type long.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): a node
    links its larger neighbours to the smallest id it sees, then its smaller ones.
    Each step moves at most as many rows as there are edges, no step gathers a
    component, and partial aggregation takes the load off nodes with many links.
    What a large-star step makes is written, as it is read twice.
    """
    found = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    last = None
    while True:
        both = found.select(F.col("b").alias("n"), F.col("a").alias("m")).unionByName(found.select(F.col("a").alias("n"), F.col("b").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = written(both.where("m > n").join(low, "n").select(F.col("low").alias("a"), F.col("m").alias("b")).where("a < b").distinct(), name)
        discard(found)
        down = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("low"))
        small = (
            large.withColumnRenamed("b", "n").join(down, "n")
            .select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("a").alias("b")), F.struct(F.col("low").alias("a"), F.col("n").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a < b").distinct()
        )
        new = written(small, name)
        n, total = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(large)
        found = new
        if (n, total) == last:
            break
        last = (n, total)
    members = found.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(found.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
