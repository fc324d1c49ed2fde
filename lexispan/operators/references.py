"""References to a symbol: identifiers that match it and no inner declaration hides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.functions.spans import covered


def not_shadowed(identifiers: DataFrame, scopes: DataFrame, declared: DataFrame) -> DataFrame:
    """Identifiers that stand in no scope which declares their name at or before them: a declaration covers its scope from its place on."""
    s = declared.join(scopes.select("file_path", "scope_id", "byte_start", "byte_end"), ["file_path", "scope_id"])
    hides = s.select("file_path", "name", F.greatest("byte_start", "declaration_pos").alias("byte_start"), "byte_end")
    return covered(identifiers, hides, ["file_path", "name"]).where("NOT covered").drop("covered")


def name_matches(identifiers: DataFrame, name: str, kind: str | None) -> DataFrame:
    """Exact name, or a qualified text that ends in it; only functions are called as methods."""
    exact = (F.col("name") == name) & ~F.col("is_qualified") & (F.col("node_kind") != "method_call")
    qualified = F.col("is_qualified") & F.endswith("qualified_text", F.lit("::" + name))
    method = (F.col("node_kind") == "method_call") & (F.col("name") == name) & F.lit(kind in (None, "function"))
    return identifiers.where(exact | qualified | method)


def outside(rows: DataFrame, start: int | Column, end: int | Column) -> DataFrame:
    """Rows not wholly inside the definition's own span."""
    s, e = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return rows.where(~((F.col("byte_start") >= s) & (F.col("byte_end") <= e)))


def context(parent: Column, qualified: Column) -> Column:
    kind = F.when(parent == "call", "FunctionCall").when(parent == "type", "TypeReference").when(parent == "use", "ImportStatement").when(parent == "field", "FieldAccess").when(parent == "generic", "GenericParameter").otherwise("Identifier")
    return F.struct(kind.alias("kind"), F.when(kind == "FunctionCall", qualified).alias("is_qualified"))


def reexported(imports: DataFrame) -> DataFrame:
    """(module_path, name) that modules pass on; a star passes nothing by name."""
    return imports.where("is_reexport").select("module_path", F.explode("imported_names").alias("name")).where("name <> '*'").distinct()


def importing_files(imports: DataFrame, reexports: DataFrame, module: str, name: str) -> DataFrame:
    """Files that can see the symbol: they import it, or a glob of it, from its module or from one that passes it on (one step)."""
    path = F.array_join("path", "::")
    passing = reexports.where(F.col("name") == name).select(F.col("module_path").alias("_from"))
    told = imports.withColumn("_path", path).where(F.array_contains("imported_names", name) | F.col("is_glob"))
    direct = told.where((F.col("_path") == module) | (F.col("_path") == module + "::" + name))
    indirect = told.join(passing, told._path == passing._from, "left_semi")
    return direct.unionByName(indirect).groupBy("file_path").agg(F.bool_or("is_glob").alias("is_glob"))


def find(symbol: dict, identifiers: DataFrame, scopes: DataFrame, declared: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_path, byte_start, byte_end, node_kind, context, origin, by_glob) of all references, in no order.

    symbol: file_path, name, kind, byte_start, byte_end, is_private. Each file is
    parsed once, by whoever made the tables; a qualified call is one reference.
    ``by_glob``: the file sees the symbol through a glob import, which other names could come from too.
    """
    seen = not_shadowed(identifiers.where(~F.col("is_qualified")), scopes, declared.where(F.col("declaration_pos") > 0).where(~((F.col("file_path") == symbol["file_path"]) & (F.col("declaration_pos") == symbol["byte_start"]))))
    usable = name_matches(seen.unionByName(identifiers.where("is_qualified")), symbol["name"], symbol["kind"]).where("parent_kind <> 'use' AND parent_kind <> 'definition'")
    here = outside(usable.where(F.col("file_path") == symbol["file_path"]), symbol["byte_start"], symbol["byte_end"]).withColumn("origin", F.lit("same_file")).withColumn("by_glob", F.lit(False))
    columns = ["file_path", "byte_start", "byte_end", "node_kind", context(F.col("parent_kind"), F.col("is_qualified")).alias("context"), "origin", "by_glob"]
    if symbol.get("is_private"):
        return here.select(columns).distinct()
    row = modules.where(F.col("file_path") == symbol["file_path"]).first()
    module = row.module_path if row else "crate"
    with_module = imports.join(modules, "file_path", "left")
    files = importing_files(with_module, reexported(with_module), module, symbol["name"]).where(F.col("file_path") != symbol["file_path"])
    there = usable.join(files.select("file_path", F.col("is_glob").alias("by_glob")), "file_path").withColumn("origin", F.lit("cross_file"))
    return here.unionByName(there).select(columns).distinct()


def by_file_descending(rows: DataFrame) -> DataFrame:
    """References grouped by file, the last place first, as edits are applied."""
    return rows.groupBy("file_path").agg(F.count("*").alias("n_refs"), F.sort_array(F.collect_list("byte_start"), asc=False).alias("starts"))
