"""Literal find and replace across files, comments left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.functions.spans import covered, literal_positions, locate
from lexispan.operators.nesting import innermost


def outside_nodes(matches: DataFrame, nodes: DataFrame, key: str = "file_path") -> DataFrame:
    """Matches that begin inside none of the nodes (key, byte_start, byte_end)."""
    return covered(matches, nodes, [key]).where("NOT covered").drop("covered")


def outside_kinds(matches: DataFrame, nodes: DataFrame, kinds: list[str], key: str = "file_path") -> DataFrame:
    """Matches whose innermost node (key, node_id, parent_id, depth, kind, byte_start, byte_end) is of none of the kinds: one sort finds it."""
    met = innermost(matches, nodes, [key]).join(nodes.where(F.col("kind").isin(kinds)).select(key, "node_id"), [key, "node_id"], "left_anti")
    return met.drop("node_id")


def places(files: DataFrame, needle: str, comments: DataFrame | None = None) -> DataFrame:
    """(file_path, nth, byte_start, byte_end): a literal that itself begins a line comment is found in comments too."""
    found = literal_positions(files, needle)
    return outside_nodes(found, comments) if comments is not None and not needle.startswith("//") else found


def find(files: DataFrame, needle: str, comments: DataFrame | None = None) -> DataFrame:
    """The places with their line_no and col."""
    return locate(places(files, needle, comments), files, "byte_start")


def replacements(files: DataFrame, needle: str, new: str, comments: DataFrame | None = None) -> DataFrame:
    """The places as replacements for ``rewrite.rewritten``."""
    found = places(files, needle, comments)
    return found.select(F.lit(0).cast("bigint").alias("batch_no"), F.col("nth").alias("ordinal"), "file_path", "byte_start", "byte_end", F.lit(new).alias("content"))
