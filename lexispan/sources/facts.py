"""Fact tables: written per snapshot as Parquet, partitioned by language where they have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_nodes(rows: DataFrame) -> DataFrame:
    """(file_path, file_id): one node a file, numbered in path order. Files are sorted by ranges; only one count per range meets in a task."""
    files = rows.select("file_path").distinct().repartitionByRange("file_path").sortWithinPartitions("file_path").withColumn("_part", F.spark_partition_id())
    inside = files.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("file_path")))
    sizes = inside.groupBy("_part").agg(F.count("*").alias("_size"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(base, "_part").select("file_path", (F.col("_n") + F.col("_base")).alias("file_id"))


def defines(symbols: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, type) from files to the entities they define."""
    return symbols.join(file_nodes(symbols), "file_path").select(F.col("file_id").alias("from_id"), F.col("entity_id").alias("to_id"), F.lit("defines").alias("type"))


#: Columns by whose values tables lie in folders, and by which rows of a file are in order: readers skip by both.
FOLDERS, ORDER = ("language", "label"), ("file_path", "name", "byte_start")


def save(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write tables; those of labels by label and else those of a language by language, rows by file, name and place."""
    for name, df in tables.items():
        folders = [c for c in FOLDERS if c in df.columns and not (c == "label" and "language" in df.columns)]
        order = [c for c in ORDER if c in df.columns]
        if "label" in folders:  # few files a label, and a common label's rows spread over tasks
            df = df.repartition("label", F.pmod(F.xxhash64("entity_id"), F.lit(8)))
        rows = df.sortWithinPartitions(*folders, *order) if folders or order else df
        (rows.write.mode(mode).partitionBy(*folders) if folders else rows.write.mode(mode)).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
