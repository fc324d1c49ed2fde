"""Span replacements: checks, rewriting, previews, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions.spans import boundary_byte, sha256, with_bytes


def overlaps(replacements: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Replacements with ``overlaps``: it begins before the end of one that begins earlier."""
    before = Window.partitionBy(*keys).orderBy("byte_start", "byte_end", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return replacements.withColumn("overlaps", F.coalesce(F.max("byte_end").over(before) > F.col("byte_start"), F.lit(False)))


def _by_file(rows: DataFrame, files: DataFrame, how: str = "inner") -> DataFrame:
    """(file_path, _rows, _text): the rows of each file as one array beside its text, which so is joined and read once."""
    own = rows.groupBy("file_path").agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    return own.join(files.select("file_path", F.col("content").alias("_text")), "file_path", how)


def checked(replacements: DataFrame, files: DataFrame) -> DataFrame:
    """Replacements with ``problem``: missing_file, bounds, utf8, overlap, or null for none."""
    met = _by_file(overlaps(replacements), files, "left")

    def problem(data, x):
        a, b, size = x["byte_start"], x["byte_end"], F.octet_length(data)
        return (
            F.when(data.isNull(), "missing_file").when(~((a >= 0) & (a <= b) & (b <= size)), "bounds")
            .when(~(boundary_byte(data, a) & boundary_byte(data, b)), "utf8").when(x["overlaps"], "overlap")
        )

    told = with_bytes("_text", lambda data: F.transform("_rows", lambda x: F.struct(x.alias("r"), problem(data, x).alias("problem"))))
    return met.select(F.inline(told)).select(*[F.col(f"r.{c}").alias(c) for c in replacements.columns], "problem")


def edited_text(content: Column, edits: Column) -> Column:
    """The text with all edits, an array of (byte_start, byte_end, content) that do not overlap.

    The kept gaps between edits in ascending order and the new texts are put together
    in one pass over bytes that are made once, so the work is that of the text and the edits together.
    """
    e = F.array_sort(edits)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(e, lambda x: x["byte_end"]))
    ends = F.concat(F.transform(e, lambda x: x["byte_start"]), F.array(F.octet_length(content).cast("bigint")))
    new = F.concat(F.transform(e, lambda x: x["content"]), F.array(F.lit("")))
    parts = F.arrays_zip(starts.alias("a"), ends.alias("b"), new.alias("n"))
    piece = lambda data: lambda x: F.concat(F.substring(data, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"), x["n"])
    return with_bytes(content, lambda data: F.array_join(F.transform(parts, piece(data)), ""))


def rewritten(replacements: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, before, after, before_sha256, after_sha256, n_edits) of each file with replacements."""
    edits = replacements.groupBy("file_path").agg(F.collect_list(F.struct(F.col("byte_start").cast("bigint").alias("byte_start"), F.col("byte_end").cast("bigint").alias("byte_end"), "content")).alias("edits"))
    met = edits.join(files.select("file_path", F.col("content").alias("before")), "file_path")
    out = met.withColumn("after", edited_text(F.col("before"), F.col("edits")))
    return out.select("file_path", "before", "after", sha256("before").alias("before_sha256"), sha256("after").alias("after_sha256"), F.size("edits").cast("bigint").alias("n_edits"))


def line_count(text: Column) -> Column:
    """Lines of a text as an editor counts what was typed: none for no text, a last line end begins no line."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.octet_length(text) == 0, 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("bigint")


def preview(replacements: DataFrame, files: DataFrame) -> DataFrame:
    """Per replacement its lines in the file, and lines and bytes taken out and put in.

    A text meets its replacements once, in order of their starts: line ends are counted between one
    start and the next, and summed inside the file.
    """
    met = _by_file(replacements, files).withColumn("_rows", F.sort_array(F.transform("_rows", lambda x: F.struct(x["byte_start"].alias("at"), x.alias("r")))))
    part = lambda data, a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    ends = lambda text: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")
    last = lambda i: F.when(i > 0, F.get("_rows", i - 1)["at"]).otherwise(F.lit(0))
    cut = lambda data: lambda x, i: F.struct(x["r"].alias("r"), i.alias("i"), ends(part(data, last(i), x["at"])).alias("ends"), line_count(part(data, x["at"], x["r"]["byte_end"])).alias("lines_removed"))
    rows = met.select("file_path", F.inline(with_bytes("_text", lambda data: F.transform("_rows", cut(data)))))
    rows = rows.withColumn("line_start", (F.sum("ends").over(Window.partitionBy("file_path").orderBy("i")) + 1).cast("bigint"))
    return rows.select(
        *[F.col(f"r.{c}").alias(c) for c in replacements.columns if c != "content"], "line_start",
        (F.col("line_start") + F.greatest(F.col("lines_removed") - 1, F.lit(0))).cast("bigint").alias("line_end"),
        "lines_removed", line_count(F.col("r.content")).alias("lines_added"),
        (F.col("r.byte_end") - F.col("r.byte_start")).alias("bytes_removed"), F.octet_length("r.content").cast("bigint").alias("bytes_added"),
    )


def verdict(gates: DataFrame, batch: str = "batch_no") -> DataFrame:
    """Gate results with ``applied``: all of the batch passed, or nothing of it is written."""
    return gates.withColumn("applied", F.bool_and("is_valid").over(Window.partitionBy(batch)))
