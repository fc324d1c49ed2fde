"""Label queries over entity_labels (entity_id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_labels(labels: DataFrame, wanted: list[str], key: str = "entity_id") -> DataFrame:
    """Entities that have every wanted label; no label wanted: all entities."""
    need = len(set(wanted))
    if not need:
        return labels.select(key).distinct()
    return labels.where(F.col("label").isin(*set(wanted))).groupBy(key).agg(F.countDistinct("label").alias("n")).where(F.col("n") == need).select(key)


def label_counts(labels: DataFrame) -> DataFrame:
    """Every label with its entities, in one pass."""
    return labels.groupBy("label").agg(F.count("*").alias("n_entities"))


def requested_counts(labels: DataFrame, wanted: list[str]) -> DataFrame:
    """Each wanted label counted for itself; one that nothing has counts 0."""
    asked = labels.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "label string")
    found = label_counts(labels.where(F.col("label").isin(*wanted)))
    return asked.join(found, "label", "left").select("label", F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def with_code(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of (file_path, byte_start, byte_end) with the code of their span, null where none is stored: one join for all rows."""
    return rows.join(chunks.select("file_path", "byte_start", "byte_end", F.col("content").alias("code")), ["file_path", "byte_start", "byte_end"], "left")


def chunk_at(chunks: DataFrame, file: str, start: int, end: int) -> DataFrame:
    return chunks.where((F.col("file_path") == file) & (F.col("byte_start") == start) & (F.col("byte_end") == end))


def chunks_of(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunks of the symbols (file_path, symbol_name) that are asked for."""
    return chunks.join(asked.select("file_path", "symbol_name"), ["file_path", "symbol_name"], "left_semi")
