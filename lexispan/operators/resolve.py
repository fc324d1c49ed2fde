"""Names to symbols: inside a file, in all files, and through imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.errors import SpanError, not_found


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key: the order is that of the source, which rows do not keep by themselves."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def in_file(symbols: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (file_path, name, kind or null) with the first symbol of the file that fits name and kind."""
    p, s = probes.alias("p"), symbols.alias("s")
    met = p.join(s, (F.col("p.file_path") == F.col("s.file_path")) & (F.col("p.name") == F.col("s.name")) & (F.col("p.kind").isNull() | (F.col("p.kind") == F.col("s.kind"))))
    picked = met.select("p.file_path", "p.name", F.col("p.kind").alias("asked_kind"), F.col("s.kind").alias("kind"), "s.byte_start", "s.byte_end", "s.ordinal")
    return first_by(picked, ["file_path", "name", "asked_kind"], "ordinal")


def by_name(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    found = symbols.where(F.col("name") == name)
    return found.where(F.col("kind") == kind) if kind else found


def ambiguous(symbols: DataFrame, key: str = "name") -> DataFrame:
    """Names that more than one symbol has, with the number and the files."""
    return symbols.groupBy(key).agg(F.count("*").alias("n_symbols"), F.countDistinct("file_path").alias("n_files")).where("n_symbols > 1")


def one(symbols: DataFrame, name: str, file: str | None = None, kind: str | None = None):
    """The symbol meant by a command: the first of the file, or the only one of all files."""
    found = by_name(symbols, name, kind)
    if file is not None:
        row = found.where(F.col("file_path") == file).orderBy("ordinal").first()
        if row is None:
            raise not_found(name, file, kind)
        return row
    rows = found.orderBy("file_path", "ordinal").limit(2).collect()
    if not rows:
        raise not_found(name, None, kind)
    if len(rows) > 1:
        files = [r.file_path for r in found.select("file_path").distinct().orderBy("file_path").collect()]
        raise SpanError("AmbiguousSymbol", f"Ambiguous symbol '{name}': found in {len(files)} files: {files}", symbol=name, hint="Name the file")
    return rows[0]


def relative_module(current, path):
    """Module that an import path means in a module: self stays, each super goes up one, others are absolute; null above the root."""
    parts = F.split(current, "::")
    ups = F.size(F.filter(path, lambda x: x == "super"))
    rest = F.filter(path, lambda x: ~x.isin("super", "self"))
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0)))
    moved = F.when(ups < F.size(parts), F.array_join(F.concat(base, rest), "::"))
    first = F.element_at(path, 1)
    return F.when(first.isin("super", "self"), moved).otherwise(F.array_join(path, "::"))


def import_targets(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports with target_file: the file of the module that the path means, seen from the importing file's module."""
    here = modules.select("file_path", F.col("module_path").alias("_here"))
    there = modules.select(F.col("module_path").alias("_target"), F.col("file_path").alias("target_file"))
    meant = imports.join(here, "file_path", "left").withColumn("_target", relative_module(F.coalesce("_here", F.lit("crate")), F.col("path")))
    met = meant.join(there, "_target", "left").drop("_target", "_here")
    return met.withColumn("target_file", F.coalesce("target_file", F.when(F.element_at("path", 1) == "self", F.col("file_path"))))


def across_files(probes: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Probes (current_file, identifier) resolved: a symbol of the file itself, else by an import that names it, else by a glob import; the first import of a kind wins.

    imports: (file_path, ordinal, imported_names, is_glob, target_file). An imported
    name that the target lacks is an alias, for which its first symbol stands.
    """
    first = first_by(symbols.select("file_path", "name", "kind", "ordinal"), ["file_path", "name"], "ordinal")
    head = first_by(symbols.select("file_path", F.col("name").alias("head_name"), F.col("kind").alias("head_kind"), "ordinal"), ["file_path"], "ordinal").drop("ordinal")
    p = probes.select("current_file", "identifier").distinct()
    local = p.join(first, (p.current_file == first.file_path) & (p.identifier == first.name)).select("current_file", "identifier", "file_path", "name", "kind", F.lit(0).alias("priority"), F.lit(0).cast("bigint").alias("import_ordinal"))
    named = imports.where("NOT is_glob AND target_file IS NOT NULL").select(F.col("file_path").alias("current_file"), F.col("ordinal").alias("import_ordinal"), "target_file", F.explode("imported_names").alias("identifier"))
    own = first.select(F.col("file_path").alias("target_file"), F.col("name").alias("identifier"), F.col("name").alias("own_name"), F.col("kind").alias("own_kind"))
    heads = head.withColumnRenamed("file_path", "target_file")
    explicit = (
        p.join(named, ["current_file", "identifier"]).join(own, ["target_file", "identifier"], "left").join(heads, "target_file", "left")
        .select("current_file", "identifier", F.col("target_file").alias("file_path"), F.coalesce("own_name", "head_name").alias("name"), F.coalesce("own_kind", "head_kind").alias("kind"), F.lit(1).alias("priority"), "import_ordinal")
        .where("name IS NOT NULL")
    )
    globs = imports.where("is_glob AND target_file IS NOT NULL").select(F.col("file_path").alias("current_file"), F.col("ordinal").alias("import_ordinal"), "target_file")
    through = p.join(globs, "current_file").join(own, ["target_file", "identifier"]).select("current_file", "identifier", F.col("target_file").alias("file_path"), F.col("own_name").alias("name"), F.col("own_kind").alias("kind"), F.lit(2).alias("priority"), "import_ordinal")
    every = local.unionByName(explicit).unionByName(through)
    return first_by(every, ["current_file", "identifier"], "priority", "import_ordinal").select("current_file", "identifier", "file_path", "name", "kind", "priority")


def path_prefixes(path, sep: str):
    """All prefixes of a path, itself included, as an array."""
    parts = F.split(path, "\\Q" + sep + "\\E", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def prefix_related(left: DataFrame, right: DataFrame, a: str, b: str, sep: str = "::") -> DataFrame:
    """Pairs of rows whose paths are equal or one the other's prefix, by whole parts.

    Each side's prefixes are exploded and joined by equality with the other side, so
    that no pair is compared for nothing; distinct ends the doubles.
    """
    l2 = left.withColumn("_p", F.explode(path_prefixes(F.col(a), sep)))
    r2 = right.withColumn("_p", F.explode(path_prefixes(F.col(b), sep)))
    down = l2.join(right, F.col("_p") == F.col(b)).drop("_p")
    up = r2.join(left, F.col("_p") == F.col(a)).drop("_p")
    columns = [*left.columns, *right.columns]
    return down.select(columns).union(up.select(columns)).distinct()
