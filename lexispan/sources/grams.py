"""A gram index for literal finds: which blocks of texts hold which three characters.

Texts lie in blocks, each a folder of its own. For every gram of three characters a
row lists the blocks that have it. A literal can only stand in blocks that have all
its grams; these alone are read, and searched exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions.spans import literal_positions

GRAM = 3


def grams(text: Column) -> Column:
    """The distinct grams of a text, in time linear in it; none of fewer characters."""
    chars = F.split(text, "")
    n = F.size(chars)
    rows = F.arrays_zip(*[F.slice(chars, k + 1, F.greatest(n - GRAM + 1, F.lit(0))).alias(f"c{k}") for k in range(GRAM)])
    return F.array_distinct(F.transform(rows, lambda c: F.concat(*[c[f"c{k}"] for k in range(GRAM)])))


def build(files: DataFrame, path: str, blocks: int = 64, parts: int | None = None) -> None:
    """Write texts (file_path, content) by blocks and the grams' lists under ``path``.

    A text's block is a hash of its path, or what a column ``block`` says. Grams of a text are made distinct where it is read, and
    those of a block before they move, so at most a row per gram and block is listed; a list is at most ``blocks`` long.
    Lists are sorted by gram, so that a reader skips what it does not ask for.
    """
    spark = files.sparkSession
    named = files if "block" in files.columns else files.withColumn("block", F.pmod(F.xxhash64("file_path"), F.lit(blocks)).cast("int"))
    kept = named.where("content IS NOT NULL").select("file_path", "content", F.col("block").cast("int").alias("block"))
    kept.repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/texts")
    stored = spark.read.schema("file_path " + files.schema["file_path"].dataType.simpleString() + ", content string, block int").parquet(f"{path}/texts")
    listed = stored.select("block", F.explode(grams(F.col("content"))).alias("gram")).distinct().groupBy("gram").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    ranged = listed.repartitionByRange(parts, "gram") if parts else listed.repartitionByRange("gram")
    ranged.sortWithinPartitions("gram").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/grams")


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/texts")


def candidates(spark: SparkSession, path: str, needle: str) -> list[int] | None:
    """Blocks that hold all grams of a literal, found by intersection; None if it is too short to have any, and all may hold it."""
    asked = sorted({needle[k : k + GRAM] for k in range(len(needle) - GRAM + 1)})
    if not asked:
        return None
    lists = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(asked))
    # a row per block that has any, at most as many as there are blocks
    both = lists.select(F.explode("blocks").alias("block")).groupBy("block").count().where(F.col("count") == len(asked))
    return sorted(r.block for r in both.select("block").collect())


def find(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(file_path, nth, byte_start, byte_end) of a literal in the indexed texts; only candidate blocks are read."""
    if not needle:
        raise ValueError("an empty literal matches nowhere")
    rows, blocks = texts(spark, path), candidates(spark, path, needle)
    if blocks is not None:
        rows = rows.where(F.col("block").isin(blocks))
    return literal_positions(rows.select("file_path", "content"), needle)
