"""Qualified names by their last parts: an index sorted by the parts in reverse, so that a suffix is a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.operators.resolve import path_prefixes


def reversed_name(name: Column | str, sep: str) -> Column:
    """The parts of a name, last first, each with a separator after it: no part is then another's beginning."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, "\\Q" + sep + "\\E", -1)
    return F.concat(F.array_join(F.reverse(parts), sep), F.lit(sep))


def build(names: DataFrame, path: str, name: str = "name", sep: str = "::", parts: int | None = None) -> None:
    """Write rows, null names left out, in the order of their reversed names; files and their row groups then hold ranges, which readers skip by."""
    rows = names.where(F.col(name).isNotNull()).withColumn("reversed_name", reversed_name(name, sep))
    ranged = rows.repartitionByRange(parts, "reversed_name") if parts else rows.repartitionByRange("reversed_name")
    ranged.sortWithinPartitions("reversed_name").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(path)


def by_suffix(spark: SparkSession, path: str, suffix: str, sep: str = "::") -> DataFrame:
    """Rows whose name is the suffix or ends in it after a separator: a range of the index, which the scan is asked for."""
    first = sep.join(reversed(suffix.split(sep))) + sep
    return spark.read.parquet(path).where((F.col("reversed_name") >= first) & F.startswith("reversed_name", F.lit(first))).drop("reversed_name")


def by_suffixes(spark: SparkSession, path: str, asked: DataFrame, sep: str = "::") -> DataFrame:
    """The same for many suffixes (suffix) at once: a name meets those asked for by equality of each of its own, as many as it has parts."""
    rows = spark.read.parquet(path)
    each = rows.withColumn("_suffix", F.explode(path_prefixes(F.expr(f"substring(reversed_name, 1, length(reversed_name) - {len(sep)})"), sep)))
    wanted = asked.select("suffix").distinct().withColumn("_suffix", F.array_join(F.reverse(F.split("suffix", "\\Q" + sep + "\\E", -1)), sep))
    return each.join(wanted, "_suffix").drop("_suffix", "reversed_name")
