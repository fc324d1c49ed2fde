"""Every identifier of a corpus bound to the symbol it means, in one plan: references and calls as tables.

An identifier means the innermost declaration of its name that its scopes hold at or
before it, else a symbol of its file, else what an import names, else what a glob
import brings. Declarations and identifiers of one name in one file are sorted
together once; the rest are joins by equality on file and name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.operators.nesting import innermost, nested
from lexispan.operators.references import context
from lexispan.operators.resolve import across_files, first_by, relative_module


def local_declarations(identifiers: DataFrame, scopes: DataFrame, declared: DataFrame) -> DataFrame:
    """Identifiers with local_pos, the place of the declaration that binds them inside their file's scopes; null for none.

    A declaration holds from its place to the end of its scope, so those of one name lie inside each other.
    """
    keys = ["file_path", "name"]
    met = declared.join(scopes.select("file_path", "scope_id", "byte_start", "byte_end"), ["file_path", "scope_id"])
    spans = met.select(*keys, F.greatest("byte_start", "declaration_pos").alias("byte_start"), "byte_end", "declaration_pos").distinct()
    nodes = nested(spans, keys)
    found = innermost(identifiers, nodes, keys)
    told = nodes.select(*keys, "node_id", F.col("declaration_pos").alias("local_pos"))
    return found.join(told, [*keys, "node_id"], "left").drop("node_id")


def qualified_targets(identifiers: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Qualified identifiers with the symbol (target_file, target_name) of the module that their path names, seen from their own; null for none."""
    parts = F.split("qualified_text", "::", -1)
    here = modules.select("file_path", F.col("module_path").alias("_here"))
    asked = identifiers.withColumn("_path", F.slice(parts, 1, F.size(parts) - 1)).join(here, "file_path", "left")
    asked = asked.withColumn("_module", relative_module(F.coalesce("_here", F.lit("crate")), F.col("_path")))
    there = modules.join(symbols.select("file_path", F.col("name").alias("target_name")), "file_path").select(F.col("module_path").alias("_module"), F.col("file_path").alias("target_file"), "target_name").distinct()
    return asked.join(there.withColumnRenamed("target_name", "_name"), (F.col("name") == F.col("_name")) & (asked._module == there._module), "left").withColumn("target_name", F.col("_name")).drop("_path", "_here", "_module", "_name")


def bind(identifiers: DataFrame, scopes: DataFrame, declared: DataFrame, symbols: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Identifiers with origin (local, file, import, glob, path or unbound), local_pos, and the target: target_file, target_name, target_kind, target_start, target_end.

    identifiers: file_path, name, byte_start, byte_end, is_qualified, qualified_text, and any other columns. ``imports`` has
    target_file as ``resolve.import_targets`` gives it. Of a file's symbols of one name the first counts. Declarations at
    place 0 are those of a file as a whole and bind nothing locally; so do declarations of the file's own symbols.
    """
    plain, dotted = identifiers.where("NOT is_qualified"), identifiers.where("is_qualified")
    own = symbols.select("file_path", F.col("byte_start").alias("declaration_pos"), "name")
    inner = declared.where("declaration_pos > 0").join(own, ["file_path", "declaration_pos", "name"], "left_anti")
    met = local_declarations(plain, scopes, inner)
    asked = met.where("local_pos IS NULL").select(F.col("file_path").alias("current_file"), F.col("name").alias("identifier")).distinct()
    found = across_files(asked, symbols, imports).select(F.col("current_file").alias("_file"), F.col("identifier").alias("_name"), F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), "priority")
    met = met.join(found, (met.file_path == found._file) & (met.name == found._name) & met.local_pos.isNull(), "left").drop("_file", "_name")
    origin = F.when(F.col("local_pos").isNotNull(), "local").when(F.col("priority") == 0, "file").when(F.col("priority") == 1, "import").when(F.col("priority") == 2, "glob").otherwise("unbound")
    through = qualified_targets(dotted, symbols, modules)
    out = met.withColumn("origin", origin).drop("priority").unionByName(through.withColumn("origin", F.when(F.col("target_file").isNull(), "unbound").otherwise("path")).withColumn("local_pos", F.lit(None).cast("bigint")))
    first = first_by(symbols.select("file_path", "name", "kind", "byte_start", "byte_end", "ordinal"), ["file_path", "name"], "ordinal")
    place = first.select(F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), F.col("byte_start").alias("target_start"), F.col("byte_end").alias("target_end"))
    return out.join(place, ["target_file", "target_name"], "left")


def references(bound: DataFrame) -> DataFrame:
    """(file_path, byte_start, byte_end, name, context, origin, target_file, target_name, target_kind, target_start, target_end) of bound identifiers that refer to a symbol: not those inside its own definition, nor imports of it."""
    away = ~((F.col("file_path") == F.col("target_file")) & (F.col("byte_start") >= F.col("target_start")) & (F.col("byte_end") <= F.col("target_end")))
    used = bound.where("target_file IS NOT NULL AND parent_kind NOT IN ('use', 'definition')").where(away)
    return used.select("file_path", "byte_start", "byte_end", "name", context(F.col("parent_kind"), F.col("is_qualified")).alias("context"), "origin", "target_file", "target_name", "target_kind", "target_start", "target_end")


def calls(bound: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, caller, caller_start, target_file, callee, callee_start, n_calls): which function calls which, how often.

    The caller is the innermost function around the call, null outside any; a call inside the callee itself is recursion and counts.
    """
    within = nested(symbols.where("kind IN ('function', 'method', 'constructor')").select("file_path", "byte_start", "byte_end", "name"), ["file_path"])
    sites = bound.where("target_file IS NOT NULL AND target_kind IN ('function', 'method', 'constructor') AND (parent_kind = 'call' OR node_kind = 'method_call')")
    sites = innermost(sites.select("file_path", "byte_start", "target_file", "target_name", "target_start"), within, ["file_path"])
    own = within.select("file_path", "node_id", F.col("name").alias("caller"), F.col("byte_start").alias("caller_start"))
    met = sites.join(own, ["file_path", "node_id"], "left")
    return met.groupBy("file_path", "caller", "caller_start", "target_file", F.col("target_name").alias("callee"), F.col("target_start").alias("callee_start")).agg(F.count("*").alias("n_calls"))
