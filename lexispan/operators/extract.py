"""Fact tables from source files: each file is lexed once, all its facts come out together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan import schema
from lexispan.functions.naming import SHORT_KINDS, detect_language, kind_label, module_path
from lexispan.functions.spans import sha256
from lexispan.session import ship
from lexispan.sources.scratch import written

#: Fact tables, and the schema of each without the columns that extraction adds.
TABLES = {"symbols": schema.SYMBOLS, "imports": schema.IMPORTS, "scopes": schema.SCOPES, "scope_symbols": schema.SCOPE_SYMBOLS, "identifiers": schema.IDENTIFIERS, "syntax_nodes": schema.SYNTAX_NODES}


def file_facts(path: str, language: str, data: bytes) -> dict[str, list[dict]]:
    """All facts of one source, by table."""
    from lexispan.parse import imports, scopes, symbols
    from lexispan.parse.lexer import Source

    out: dict[str, list[dict]] = {name: [] for name in TABLES}
    if language not in symbols.EXTRACTORS:
        return out
    src = Source(data, language)
    out["symbols"] = [s | {"language": language, "ordinal": i} for i, s in enumerate(symbols.EXTRACTORS[language](src))]
    out["imports"] = [s | {"ordinal": i} for i, s in enumerate(imports.EXTRACTORS[language](src))]
    out["syntax_nodes"] = [{"node_id": i, "kind": "comment", "depth": 1, "byte_start": a, "byte_end": b} for i, (a, b) in enumerate(src.comments)]
    if language == "rust":
        out["scopes"], out["scope_symbols"] = scopes.scopes(src)
        out["identifiers"] = scopes.identifiers(src)
    for rows in out.values():
        for r in rows:
            r["file_path"] = path
    return out


def _facts(batches):
    import pyarrow as pa

    for b in batches:
        names, bodies = [], []
        for path, language, content in zip(b.column("file_path").to_pylist(), b.column("language").to_pylist(), b.column("content").to_pylist(), strict=True):
            for name, rows in file_facts(path, language, (content or "").encode()).items():
                names.extend([name] * len(rows))
                bodies.extend(json.dumps(r) for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.string())], ["fact", "body"])


def facts(files: DataFrame) -> DataFrame:
    """(fact, body) rows of files (file_path, language, content); to be persisted before ``table`` splits it, so that parsing runs once."""
    ship(files.sparkSession)
    known = files.where("language IS NOT NULL").select("file_path", "language", "content")
    return known.mapInArrow(_facts, "fact string, body string")


def table(facts_: DataFrame, name: str) -> DataFrame:
    return facts_.where(F.col("fact") == name).select(F.from_json("body", TABLES[name]).alias("r")).select("r.*")


def source_files(contents: DataFrame) -> DataFrame:
    """(file_path, language, content, n_bytes, sha256) of (file_path, content)."""
    return contents.select("file_path", detect_language("file_path").alias("language"), "content", F.octet_length("content").cast("bigint").alias("n_bytes"), sha256("content").alias("sha256"))


def entities(symbols: DataFrame) -> DataFrame:
    """Symbols with entity_id, from file and place, so that it does not change from run to run, and the label of their kind."""
    return symbols.withColumn("entity_id", F.xxhash64("file_path", "byte_start", "name", "kind")).withColumn("label", kind_label("kind"))


def entity_labels(symbols: DataFrame) -> DataFrame:
    """(entity_id, label): the language and the short kind of each entity."""
    short = F.create_map(*[F.lit(x) for pair in SHORT_KINDS.items() for x in pair])[F.col("kind")]
    return symbols.select("entity_id", F.explode(F.array_distinct(F.array("language", F.coalesce(short, F.col("kind"))))).alias("label"))


def code_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, byte_start, byte_end, symbol_name, content) of the symbols' code."""
    text = F.substring(F.encode("content", "UTF-8"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")).cast("string")
    return symbols.join(files.select("file_path", "content"), "file_path").select("file_path", "byte_start", "byte_end", F.col("name").alias("symbol_name"), text.alias("content"))


def bound_tables(parsed: DataFrame, symbols: DataFrame, files: DataFrame, root: str) -> dict[str, DataFrame]:
    """The tables ``references`` and ``calls`` of parsed facts: all identifiers are bound in one plan.

    calls: (from_id, to_id, type, n_calls) between entities; a call outside any function has no row.
    """
    from lexispan.operators import binding, resolve

    t = {n: table(parsed, n) for n in TABLES}
    modules = files.select("file_path", module_path(root, "file_path").alias("module_path"))
    bound = written(binding.bind(t["identifiers"], t["scopes"], t["scope_symbols"], symbols, resolve.import_targets(t["imports"], modules), modules), "bound")
    ids = symbols.select("file_path", "name", "byte_start", "entity_id").dropDuplicates(["file_path", "name", "byte_start"])
    end = lambda file, name, start, into: ids.select(F.col("file_path").alias(file), F.col("name").alias(name), F.col("byte_start").alias(start), F.col("entity_id").alias(into))
    called = binding.calls(bound, symbols).join(end("file_path", "caller", "caller_start", "from_id"), ["file_path", "caller", "caller_start"]).join(end("target_file", "callee", "callee_start", "to_id"), ["target_file", "callee", "callee_start"])
    return {"references": binding.references(bound), "calls": called.select("from_id", "to_id", F.lit("calls").alias("type"), "n_calls")}


def index(files: DataFrame, path: str, root: str = "") -> int:
    """Write all fact tables of the files under ``path``, references and calls of all symbols with them; the number of symbols. Modules are named from ``root`` on."""
    from lexispan.sources.facts import save

    spark: SparkSession = files.sparkSession
    facts(files).write.mode("overwrite").partitionBy("fact").parquet(f"{path}/facts")  # each table is read from its own folder
    save({"source_files": files}, path)
    parsed, kept = spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/source_files")
    symbols = entities(table(parsed, "symbols"))
    save({"symbols": symbols} | {n: table(parsed, n) for n in TABLES if n != "symbols"}, path)
    own = spark.read.parquet(f"{path}/symbols")
    save({"entity_labels": entity_labels(own), "code_chunks": code_chunks(own, kept)}, path)
    save(bound_tables(parsed, own, kept, root), path)
    return own.count()
