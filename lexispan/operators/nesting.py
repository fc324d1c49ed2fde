"""Nested spans: trees from opening and closing marks, and the innermost span at an offset.

Everything is sums, ranks and last values over rows sorted inside a file: marks are
paired by running depth and rank within it, parents are the last span of one depth
less, and offsets meet spans in one sort that carries the innermost on. No row is
compared with each other row, and no text is held beyond its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements of HTML that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_RAW = "|".join(f"<{w}(?:[ \\t\\r\\n\\f/][^>]*)?>.*?</{w}[ \\t\\r\\n\\f]*>" for w in ("[sS][cC][rR][iI][pP][tT]", "[sS][tT][yY][lL][eE]"))
#: A piece of markup: a comment, a script or a style with all its text, a declaration, or a tag with quoted attributes.
MARKUP = rf"""(?s)<!--.*?-->|{_RAW}|<![^>]*>|</?[A-Za-z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>"""


def pieces(texts: DataFrame, pattern: str, key: str = "file_path", content: str = "content") -> DataFrame:
    """(key, nth, byte_start, byte_end, node) of all matches of a pattern, from running sums of the bytes of matches and of what is between them."""
    both = F.arrays_zip(F.split(content, pattern, -1).alias("gap"), F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("node"))
    rows = texts.select(key, F.posexplode(both).alias("nth", "x")).select(key, "nth", "x.node", F.octet_length("x.gap").cast("bigint").alias("_gap"), F.coalesce(F.octet_length("x.node"), F.lit(0)).cast("bigint").alias("_own"))
    end = F.sum(F.col("_gap") + F.col("_own")).over(Window.partitionBy(key).orderBy("nth"))
    return rows.withColumn("byte_end", end.cast("bigint")).where("node IS NOT NULL").select(key, F.col("nth").cast("bigint").alias("nth"), (F.col("byte_end") - F.col("_own")).alias("byte_start"), "byte_end", "node")


def html_marks(pages: DataFrame) -> DataFrame:
    """(file_path, byte_start, byte_end, name, mark): mark is 1 for a start tag, -1 for an end tag and 0 for what holds nothing. Names are lower case; comments are !--, declarations !."""
    found = pieces(pages, MARKUP)
    name = F.lower(F.regexp_extract("node", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    name = F.when(F.startswith("node", F.lit("<!--")), "!--").when(F.startswith("node", F.lit("<!")), "!").otherwise(name)
    leaf = F.col("name").isin("!--", "!", "script", "style", *VOID) | F.endswith("node", F.lit("/>"))
    mark = F.when(F.startswith("node", F.lit("</")), F.when(F.col("name").isin(*VOID), 0).otherwise(-1)).when(leaf, 0).otherwise(1)
    return found.withColumn("name", name).select("file_path", "byte_start", "byte_end", "name", mark.cast("bigint").alias("mark"))


def tree(marks: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, node_id, parent_id, name, depth, byte_start, byte_end, is_closed) of the nodes that marks make.

    Marks without a partner of their name are set aside first: closing ones go, opening
    ones are nodes that hold nothing but themselves. What is left is balanced for each name
    and so altogether, and is paired by depth; where names then differ, two pairs cross,
    and these marks are set aside as well. Nodes are numbered in order of their starts from 0;
    parent_id is null at depth 1. All sorting is inside a file.
    """
    own = Window.partitionBy(key, "name").orderBy("byte_start")
    back = Window.partitionBy(key, "name").orderBy(F.desc("byte_start"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.repartition(key).withColumn("_sum", F.sum("mark").over(own)).withColumn("_rest", -F.sum("mark").over(back))
    rows = rows.withColumn("_low", F.least(F.min("_sum").over(before(own)), F.lit(0))).withColumn("_high", F.least(F.min("_rest").over(before(back)), F.lit(0)))
    stray = ((F.col("mark") < 0) & (F.col("_sum") < F.col("_low"))) | ((F.col("mark") > 0) & (F.col("_rest") < F.col("_high")))
    rows = rows.withColumn("_paired", F.when(stray | (F.col("mark") == 0), 0).otherwise(F.col("mark")))
    rows = rows.withColumn("_level", F.sum("_paired").over(Window.partitionBy(key).orderBy("byte_start")) + F.when(F.col("_paired") < 0, 1).otherwise(0))
    # at one level opens and closes take turns; marks set aside have turns of their own
    turn = Window.partitionBy(key, "_level", F.col("_paired") == 0).orderBy("byte_start")
    partner = F.when(F.col("_paired") > 0, F.lead("name").over(turn)).when(F.col("_paired") < 0, F.lag("name").over(turn))
    rows = rows.withColumn("_end", F.when(F.col("_paired") > 0, F.lead("byte_end").over(turn))).withColumn("_kept", F.when(partner == F.col("name"), F.col("_paired")).otherwise(0))
    rows = rows.withColumn("_depth", F.sum("_kept").over(Window.partitionBy(key).orderBy("byte_start")))
    nodes = rows.where("_kept > 0 OR (_kept = 0 AND mark >= 0)").select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("byte_start")) - 1).cast("bigint").alias("node_id"), "name",
        (F.col("_depth") + F.when(F.col("_kept") == 0, 1).otherwise(0)).cast("bigint").alias("depth"), "byte_start",
        F.when(F.col("_kept") > 0, F.col("_end")).otherwise(F.col("byte_end")).alias("byte_end"), ((F.col("_kept") > 0) | (F.col("mark") == 0)).alias("is_closed"),
    )
    return parents(nodes, [key]).select(key, "node_id", "parent_id", "name", "depth", "byte_start", "byte_end", "is_closed")


def parents(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with parent_id: the last node of one depth less that began before. Each node stands among those of its depth, and once more one up, to ask."""
    rows = nodes.select(*nodes.columns, F.explode(F.array(F.struct(F.lit(False).alias("asks"), F.col("depth").alias("at")), F.struct(F.lit(True).alias("asks"), (F.col("depth") - 1).alias("at")))).alias("_x"))
    rows = rows.select(*nodes.columns, F.col("_x.asks").alias("_asks"), F.col("_x.at").alias("_at"), F.when(~F.col("_x.asks"), F.col("node_id")).alias("_id"))
    last = F.last("_id", ignorenulls=True).over(Window.partitionBy(*keys, "_at").orderBy("byte_start", "_asks", "node_id"))
    return rows.withColumn("parent_id", last).where("_asks").drop("_asks", "_at", "_id")


def nested(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, byte_start, byte_end) that lie apart or inside each other, with node_id, parent_id and depth; of equal ones the earlier by their other columns is outside. Empty spans go."""
    payload = F.struct(*[c for c in spans.columns if c not in keys])
    marks = spans.where("byte_start < byte_end").select(*keys, payload.alias("_row"), F.explode(F.array(F.struct(F.lit(1).alias("mark"), F.col("byte_start").alias("at")), F.struct(F.lit(-1).alias("mark"), F.col("byte_end").alias("at")))).alias("_m"))
    # ends before starts; of starts the longest first
    by = Window.partitionBy(*keys).orderBy("_m.at", "_m.mark", F.desc("_row.byte_end"), "_row")
    rows = marks.withColumn("depth", F.sum("_m.mark").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).withColumn("node_id", F.sum(F.when(F.col("_m.mark") > 0, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint") - 1)
    return parents(rows.where("_m.mark > 0").select(*keys, "_row.*", "node_id", "depth"), keys)


def innermost(points: DataFrame, nodes: DataFrame, keys: list[str], at: str = "byte_start") -> DataFrame:
    """Points with ``node_id`` of the innermost node (keys, node_id, parent_id, depth, byte_start, byte_end) that holds them, null for none.

    Where a node begins it is the innermost, and where it ends its parent is; the last such
    change at or before a point tells. Nodes and points are sorted together once per key.
    """
    change = F.explode(F.array(F.struct(F.col("byte_start").alias("at"), F.lit(1).alias("turn"), F.col("depth").alias("rank"), F.col("node_id").alias("id")), F.struct(F.col("byte_end").alias("at"), F.lit(0).alias("turn"), (-F.col("depth")).alias("rank"), F.col("parent_id").alias("id"))))
    table = nodes.select(*keys, change.alias("_c")).select(*keys, F.col("_c.at").cast("bigint").alias("_at"), "_c.turn", "_c.rank", F.struct(F.col("_c.id").alias("id")).alias("_id"))
    ask = points.select(*keys, F.col(at).cast("bigint").alias("_at"), F.lit(2).alias("turn"), F.lit(0).cast("bigint").alias("rank"), F.lit(None).cast("struct<id: bigint>").alias("_id"), F.struct(*points.columns).alias("_row"))
    table = table.withColumn("rank", F.col("rank").cast("bigint")).withColumn("_id", F.col("_id").cast("struct<id: bigint>")).withColumn("_row", F.lit(None).cast(ask.schema["_row"].dataType)).dropna(subset=keys)
    last = F.last("_id", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", "turn", "rank").rowsBetween(Window.unboundedPreceding, 0))
    return ask.unionByName(table).withColumn("_id", last).where("turn = 2").select("_row.*", F.col("_id.id").alias("node_id"))
