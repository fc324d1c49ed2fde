"""Compiler output to rows: lines are exploded, and patterns and windows over their order do the rest.

Input: (run_id, file, output). Output: (run_id, nth, level, file, line, column,
message, code, note). Where a tool said something that no line pattern fits, the
whole output is one message; only the rustc form has no such fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["run_id", "nth", "level", "file", "line", "column", "message", "code", "note"]


def lines(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.col("file").alias("_file"), F.posexplode(F.split("output", "\r?\n", -1)).alias("nth", "text"))


def _rows(found: DataFrame, level, file, line, column, message, code=None, note=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return found.select(
        "run_id", F.col("nth").cast("bigint").alias("nth"), level.alias("level"), file.alias("file"), line.cast("bigint").alias("line"), column.cast("bigint").alias("column"),
        message.alias("message"), (none if code is None else code).alias("code"), (none if note is None else note).alias("note"),
    )


def with_fallback(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Where a run said anything but gave no row, all of it as one message."""
    silent = runs.where(F.trim("output") != "").join(rows.select("run_id").distinct(), "run_id", "left_anti")
    whole = _rows(silent.withColumn("nth", F.lit(0)), F.lit("error"), F.col("file"), F.lit(0), F.lit(0), F.regexp_replace(F.regexp_replace("output", r"^\s+", ""), r"\s+$", ""))
    return rows.unionByName(whole)


def _part(pattern: str, n: int) -> Column:
    return F.regexp_extract("text", pattern, n)


def rustc(runs: DataFrame) -> DataFrame:
    """Headers wait for a location line; note and help lines go to the last header that got one, joined by line ends."""
    header, place, said = r"^(error|warning)(?:\[([^\]]*)\])?:\s*(.*)$", r"^-->\s*(.*):(\d+):(\d+)$", r"^(?:[|]\s*)?(?:=\s*)?(?:note|help):?\s*(.*)$"
    rows = lines(runs).withColumn("text", F.trim("text")).where("text <> ''")
    rows = rows.withColumns({"is_header": F.col("text").rlike(header), "is_place": F.col("text").rlike(place)})
    order = Window.partitionBy("run_id").orderBy("nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the last header or place before a place: a header that still waits, or one that is served
    rows = rows.withColumn("last", F.last(F.when(F.col("is_header") | F.col("is_place"), F.struct("is_header", "text")), True).over(before))
    rows = rows.withColumn("starts", F.col("is_place") & F.coalesce(F.col("last.is_header"), F.lit(False)))
    rows = rows.withColumn("group", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    note = F.when(~F.col("is_header") & ~F.col("is_place") & F.col("text").rlike(said), F.regexp_extract("text", said, 1))
    own = rows.where("group > 0").groupBy("run_id", "group").agg(
        F.min(F.when(F.col("starts"), F.struct("nth", "last.text", F.col("text").alias("place")))).alias("d"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("nth", note.alias("note"))))), lambda x: x["note"]), "\n").alias("note"),
    )
    head = lambda n: F.regexp_extract("d.text", header, n)
    at = lambda n: F.regexp_extract("d.place", place, n)
    return _rows(own.withColumn("nth", F.col("d.nth")), head(1), at(1), at(2), at(3), head(3), F.nullif(head(2), F.lit("")), F.nullif(F.col("note"), F.lit("")))


def gcc(runs: DataFrame) -> DataFrame:
    """file:line:col: error or warning; the message keeps that word."""
    p = r"^\s*([^:]*?)\s*:\s*(\d+)\s*:\s*(\d+)\s*:\s*(.*?)\s*$"
    found = lines(runs).where((F.contains("text", F.lit(": error: ")) | F.contains("text", F.lit(": warning: "))) & F.col("text").rlike(p))
    return _rows(found, F.when(F.contains("text", F.lit(": error: ")), "error").otherwise("warning"), _part(p, 1), _part(p, 2), _part(p, 3), _part(p, 4))


def javac(runs: DataFrame) -> DataFrame:
    p = r"^[^:]*:\s*(\d+)\s*:.*?error: (.*?)\s*$"
    found = lines(runs).where(F.contains("text", F.lit(": error: ")) & F.col("text").rlike(p))
    return with_fallback(_rows(found, F.lit("error"), F.col("_file"), _part(p, 1), F.lit(0), _part(p, 2)), runs)


def node(runs: DataFrame) -> DataFrame:
    """file:line (col) message, or without the column."""
    p = r"^[^:]*:(\d+) (?:\((\d+)\))?\s*(.*?)\s*$"
    found = lines(runs).where(F.contains(F.col("text"), F.col("_file")) & F.col("text").rlike(p))
    return with_fallback(_rows(found, F.lit("error"), F.col("_file"), _part(p, 1), F.coalesce(F.try_to_number(_part(p, 2), F.lit("999999999")), F.lit(0)), _part(p, 3)), runs)


def tsc(runs: DataFrame) -> DataFrame:
    p = r"^[^(]*\(\s*(\d+)\s*,\s*(\d+)\s*\)(.*)$"
    coded = r"(TS[^:]*?)\s*:\s*(.*?)\s*$"
    found = lines(runs).where(F.contains(F.col("text"), F.col("_file")) & (F.contains("text", F.lit(": error ")) | F.contains("text", F.lit("TS"))) & F.col("text").rlike(p))
    found = found.withColumn("rest", _part(p, 3))
    has = F.col("rest").rlike(coded)
    message = F.when(has, F.regexp_extract("rest", coded, 2)).when(F.contains("rest", F.lit("error ")), F.trim(F.regexp_extract("rest", r"error (.*)$", 1))).otherwise(F.trim(F.regexp_replace("rest", r"^\s*:?\s*", "")))
    rows = _rows(found, F.lit("error"), F.col("_file"), _part(p, 1), _part(p, 2), message, F.when(has, F.regexp_extract("rest", coded, 1)))
    return with_fallback(rows.where("message <> ''"), runs)


def python(runs: DataFrame) -> DataFrame:
    """A file and line, then within four lines what the SyntaxError says; alone, the error's line serves."""
    p, said = r'File ".*, line (\d+)"?\s*$', r"SyntaxError: (.*?)\s*$"
    order = Window.partitionBy("run_id").orderBy("nth")
    message = F.when(F.col("text").rlike(said), F.regexp_extract("text", said, 1))
    rows = lines(runs).withColumn("message", message)
    rows = rows.withColumn("ahead", F.coalesce(*[F.lead("message", k).over(order) for k in range(1, 5)]))
    placed = _rows(rows.where(F.col("text").rlike(p) & F.col("ahead").isNotNull()), F.lit("error"), F.col("_file"), F.regexp_extract("text", p, 1), F.lit(0), F.col("ahead"))
    alone = rows.where("message IS NOT NULL").join(placed.select("run_id").distinct(), "run_id", "left_anti").groupBy("run_id", F.col("_file")).agg(F.min(F.struct("nth", "message")).alias("m")).select("run_id", "_file", "m.nth", "m.message")
    return with_fallback(placed.unionByName(_rows(alone, F.lit("error"), F.col("_file"), F.lit(0), F.lit(0), F.col("message"))), runs)


PARSERS = {"rust": rustc, "python": python, "c": gcc, "cpp": gcc, "java": javac, "javascript": node, "typescript": tsc}
