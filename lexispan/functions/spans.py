"""Byte spans of UTF-8 text. Strings are encoded once and cut as BINARY: Spark's string functions count characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice_bytes(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """Bytes [start, end) of a text."""
    s = as_column(start)
    return F.substring(F.encode(as_column(content), "UTF-8"), (s + 1).cast("int"), (as_column(end) - s).cast("int"))


def span_ok(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """0 <= start <= end <= length."""
    return (as_column(start) >= 0) & (as_column(start) <= as_column(end)) & (as_column(end) <= F.octet_length(as_column(content)))


def boundary_byte(data: Column, at: Column) -> Column:
    """Of BINARY data: no continuation byte 10xxxxxx stands at the offset."""
    return ~F.substring(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))), 1, 1).isin("8", "9", "A", "B")


def at_boundary(content: Column | str, at: Column | str) -> Column:
    """The offset is where a character begins or the text ends."""
    return boundary_byte(F.encode(as_column(content), "UTF-8"), as_column(at))


def with_bytes(content: Column | str, f) -> Column:
    """f of a text's bytes, which are made once however often f's own lambdas use them."""
    return F.transform(F.array(F.encode(as_column(content), "UTF-8")), f)[0]


def utf8_ok(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """Both ends of a span stand between characters; so does a span of no bytes inside none."""
    return span_ok(content, start, end) & at_boundary(content, start) & at_boundary(content, end)


def sha256(content: Column | str) -> Column:
    return F.sha2(as_column(content), 256)


def line_index(files: DataFrame, key: str = "file_path", content: str = "content") -> DataFrame:
    """(key, line_no from 1, byte_start, n_bytes) of every line, the line end not counted."""
    lines = files.select(key, F.posexplode(F.split(content, "\n", -1)).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("bigint").alias("line_no"), F.octet_length("line").cast("bigint").alias("n_bytes"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("byte_start", F.coalesce(F.sum(F.col("n_bytes") + 1).over(before), F.lit(0)).cast("bigint")).select(key, "line_no", "byte_start", "n_bytes")


def locate(offsets: DataFrame, files: DataFrame, offset: str, key: str = "file_path", content: str = "content") -> DataFrame:
    """Line (from 1) and byte column (from 0) of offsets, as of the lines of the files that have any."""
    asked = files.select(key, content).join(offsets.select(key).distinct(), key, "left_semi")
    return offset_to_line(offsets, line_index(asked, key, content), offset, key)


def covered(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "byte_start") -> DataFrame:
    """Points with ``covered``: they stand in a span (keys, byte_start, byte_end) of their keys, its end left out.

    Span starts and points are sorted together per key and the furthest end so far is
    carried on: one sort instead of each point against each span. Points with a null
    key stand in none.
    """
    probe = points.select(*keys, F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_probe"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("bigint").alias("_end"))
    table = spans.select(*keys, F.col("byte_start").cast("bigint").alias("_at"), F.lit(0).alias("_probe"), F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), F.col("byte_end").cast("bigint").alias("_end")).dropna(subset=keys)
    upto = Window.partitionBy(*keys).orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    met = probe.unionByName(table).withColumn("_end", F.max("_end").over(upto))
    return met.where("_probe = 1").select("_row.*", F.coalesce(F.col("_end") > F.col("_at"), F.lit(False)).alias("covered"))


def offset_to_line(offsets: DataFrame, lines: DataFrame, offset: str, key: str = "file_path") -> DataFrame:
    """As-of join: the last line that begins at or before the offset.

    Offsets and line starts are sorted together per file and the last start is carried
    on, so the work is one sort instead of every offset against every line.
    """
    ids = [c for c in offsets.columns if c not in (key, offset)]
    probe = offsets.select(key, F.col(offset).alias("_at"), F.lit(1).alias("_probe"), F.struct(*ids).alias("_row") if ids else F.lit(None).alias("_row"), F.lit(None).cast("bigint").alias("_line"), F.lit(None).cast("bigint").alias("_start"))
    table = lines.select(key, F.col("byte_start").alias("_at"), F.lit(0).alias("_probe"), F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), F.col("line_no").alias("_line"), F.col("byte_start").alias("_start"))
    upto = Window.partitionBy(key).orderBy("_at", "_probe", "_line").rowsBetween(Window.unboundedPreceding, 0)
    met = probe.unionByName(table).withColumn("line_no", F.last("_line", True).over(upto)).withColumn("_begin", F.last("_start", True).over(upto))
    return met.where("_probe = 1").select(key, *[F.col(f"_row.{c}").alias(c) for c in ids], F.col("_at").alias(offset), "line_no", (F.col("_at") - F.col("_begin")).alias("col"))


def literal_positions(files: DataFrame, needle: str, key: str = "file_path", content: str = "content") -> DataFrame:
    """(key, nth from 0, byte_start, byte_end) of a literal's matches, left to right, none overlapping.

    The text is split on the quoted literal, and running sums of the parts' bytes
    give the places. An empty literal is refused.
    """
    if not needle:
        raise ValueError("an empty literal matches nowhere")
    size = len(needle.encode())
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pieces = files.where(F.contains(F.col(content), F.lit(needle))).select(key, F.posexplode(F.split(content, quoted, -1)).alias("nth", "piece")).select(key, "nth", F.octet_length("piece").cast("bigint").alias("n"))
    by = Window.partitionBy(key).orderBy("nth")
    upto = pieces.withColumn("byte_start", (F.sum(F.col("n") + size).over(by.rowsBetween(Window.unboundedPreceding, 0)) - size).cast("bigint")).withColumn("last", F.lead("nth").over(by).isNull())
    return upto.where(~F.col("last")).select(key, F.col("nth").cast("bigint").alias("nth"), "byte_start", (F.col("byte_start") + size).alias("byte_end"))
