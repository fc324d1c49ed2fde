"""The seven commands: facts and edits as DataFrames, a verdict, then one journalled commit by the executors.

Nothing is written before all gates that need no files have passed; gates that run
compilers over the workspace follow the write, which they undo if they fail.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.errors import SpanError, not_found
from lexispan.functions.naming import language_of, module_path
from lexispan.operators import extract, gates, labels, pattern, references, resolve, rewrite
from lexispan.sources import backup, facts, files, journal
from lexispan.sources.scratch import discard, written


def _language(path: str, given: str | None) -> str:
    language = given or language_of(path)
    if language is None:
        raise SpanError("Other", f"cannot tell the language of {path}", file=path, hint="Name it with --language")
    return language


def _sources(spark: SparkSession, paths: list[str], given: str | None = None) -> DataFrame:
    for p in paths:
        if not os.path.isfile(p):
            raise SpanError("Io", f"I/O error for path {p}: no such file", file=p)
    rows = files.read_texts(spark, paths)
    bad = rows.where("NOT is_utf8").select("file_path").limit(1).collect()
    if bad:
        raise SpanError("Utf8", f"{bad[0].file_path} is not UTF-8", file=bad[0].file_path)
    out = extract.source_files(rows)
    return out.withColumn("language", F.lit(given)) if given else out


def _metadata(text: str | None):
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def _payload(message: str, data: dict, operation_id: str | None = None, metadata: str | None = None, manifest: str | None = None) -> dict:
    extra = {"operation_id": operation_id, "metadata": _metadata(metadata), "backup_manifest": manifest}
    return {"status": "ok", "message": message, "data": data | {k: v for k, v in extra.items() if v is not None}}


def _check(edits: DataFrame, sources: DataFrame) -> None:
    """Edits that cannot be made are reported together."""
    bad = rewrite.checked(edits, sources).where("problem IS NOT NULL").orderBy("file_path", "byte_start").collect()
    if bad:
        b = bad[0]
        raise SpanError("InvalidSpan", f"Invalid span ({b.byte_start}, {b.byte_end}) in {b.file_path}: {b.problem}", file=b.file_path, diagnostics=[{"tool": "spans", "level": "error", "message": r.problem, "file": r.file_path} for r in bad])


def apply(spark: SparkSession, edits: DataFrame, sources: DataFrame, *, workspace: str | None = None, language: str | None = None, compilers: bool = False, analyzer: str = "off", validate: bool = True, create_backup: bool = False, operation_id: str | None = None, write: bool = True) -> dict:
    """Check, rewrite, gate and commit edits; all files or none. Gives the files' hashes and the backup's manifest."""
    _check(edits, sources)
    out = written(rewrite.rewritten(edits, sources).join(sources.select("file_path", "language"), "file_path").select("file_path", "language", "after", "before_sha256", "after_sha256", "n_edits"), "rewritten")
    if validate:
        failed = gates.parse_gate(out).where("NOT is_valid").orderBy("file_path").limit(1).collect()
        if failed:
            raise SpanError("ParseValidationFailed", f"Parse validation failed: file '{failed[0].file_path}' - the result has syntax errors", file=failed[0].file_path)
    rows = out.drop("after").orderBy("file_path").collect()  # names and hashes: what the payload lists
    result = {"files": [{"file": r.file_path, "before_hash": r.before_sha256, "after_hash": r.after_sha256, "replacements": r.n_edits} for r in rows]}
    if not write:
        return result
    manifest = None
    if create_backup and rows:
        base = workspace or os.path.commonpath([os.path.dirname(r.file_path) for r in rows])
        operation_id, manifest = backup.save(base, [r.file_path for r in rows], operation_id, spark)

    def gate() -> None:
        if compilers:
            for own in sorted({r.language for r in rows if r.language}):
                paths = [r.file_path for r in rows if r.language == own]
                said, found = gates.compiler_gate(spark, paths, own, workspace)
                if not all(x["is_valid"] for x in said):
                    kind = "CargoCheckFailed" if own == "rust" else "CompilerValidationFailed"
                    told = [{k: v for k, v in r.asDict().items() if v is not None} for r in found.collect()]
                    raise SpanError(kind, f"Compiler validation failed for {own}", file=paths[0], diagnostics=told)
        if analyzer != "off" and workspace:
            gates.analyzer_gate(workspace, analyzer)

    if rows:
        base = workspace or os.path.commonpath([os.path.dirname(r.file_path) for r in rows])
        journal.commit(spark, out, base, gate if compilers or analyzer != "off" else None)
    discard(out)
    return result | {"operation_id": operation_id, "backup_manifest": manifest}


def _edit(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "batch_no bigint, ordinal bigint, file_path string, byte_start bigint, byte_end bigint, content string")


def _find_symbol(spark: SparkSession, path: str, name: str, kind: str | None, language: str):
    sources = _sources(spark, [path], language)
    symbols = extract.table(extract.facts(sources), "symbols")
    return resolve.one(symbols, name, path, kind), sources


def patch(spark, file: str, symbol: str, new: str, kind=None, language=None, preview=False, create_backup=False, operation_id=None, metadata=None, **gate) -> dict:
    """Replace a symbol's definition by the text ``new``."""
    path = os.path.abspath(file)
    found, sources = _find_symbol(spark, path, symbol, kind, _language(path, language))
    edits = _edit(spark, [(0, 0, path, found.byte_start, found.byte_end, new)])
    done = apply(spark, edits, sources, create_backup=create_backup, operation_id=operation_id, write=not preview, workspace=files.workspace_root(path) or os.path.dirname(path), **gate)
    data = done | {"symbol": symbol, "kind": found.kind, "span": {"start": found.byte_start, "end": found.byte_end}}
    if preview:
        report = rewrite.preview(edits, sources).first().asDict()
        return _payload(f"Previewed patch of '{symbol}'", data | {"preview": {k: v for k, v in report.items() if k not in ("batch_no", "ordinal")}}, operation_id, metadata)
    return _payload(f"Patched '{symbol}' in {file}", {k: v for k, v in data.items() if k not in ("operation_id", "backup_manifest")}, done["operation_id"], metadata, done["backup_manifest"])


def patch_batch(spark, batch: str, create_backup=False, operation_id=None, metadata=None, language=None, **gate) -> dict:
    """All replacements of a batch file, or none."""
    edits = files.read_batches(spark, batch)
    paths = [r.file_path for r in edits.select("file_path").distinct().orderBy("file_path").collect()]
    done = apply(spark, edits, _sources(spark, paths, language), create_backup=create_backup, operation_id=operation_id, workspace=files.workspace_root(paths[0]) or os.path.commonpath([os.path.dirname(p) for p in paths]), **gate)
    return _payload(f"Patched {len(done['files'])} file(s)", {"files": done["files"]}, done["operation_id"], metadata, done["backup_manifest"])


def reference_edits(spark, path: str, symbol: str, kind: str | None, language: str) -> tuple[DataFrame, DataFrame, dict]:
    """Empty replacements for a definition and all references to it, and the files they are in."""
    found, sources = _find_symbol(spark, path, symbol, kind, language)
    rows, by_glob = [(0, 0, path, found.byte_start, found.byte_end, "")], False
    root = files.workspace_root(path)
    if language == "rust":
        everything = sources
        if root and found.visibility.level != "private":
            everything = sources.unionByName(files.scan_rust(spark, root).where(F.col("file_path") != path))
        everything = everything.persist()
        parsed = extract.facts(everything).persist()
        t = {n: extract.table(parsed, n) for n in ("identifiers", "scopes", "scope_symbols", "imports")}
        modules = everything.select("file_path", module_path(root or os.path.dirname(path), "file_path").alias("module_path"))
        target = {"file_path": path, "name": symbol, "kind": found.kind, "byte_start": found.byte_start, "byte_end": found.byte_end, "is_private": found.visibility.level == "private"}
        refs = references.find(target, t["identifiers"], t["scopes"], t["scope_symbols"], t["imports"], modules).orderBy(F.desc("byte_start"), "file_path").collect()
        rows += [(0, i + 1, r.file_path, r.byte_start, r.byte_end, "") for i, r in enumerate(refs)]
        by_glob = any(r.by_glob for r in refs)
        sources = everything
    told = {"references": len(rows) - 1, "kind": found.kind}
    if by_glob:
        told["warnings"] = [f"some references to '{symbol}' are seen through glob imports and may mean another symbol"]
    return _edit(spark, rows), sources, told


def delete(spark, file: str, symbol: str, kind=None, language=None, create_backup=False, operation_id=None, metadata=None, validate=False, **gate) -> dict:
    """Remove a definition and, for Rust, the references to it; one commit for all files."""
    path = os.path.abspath(file)
    edits, sources, told = reference_edits(spark, path, symbol, kind, _language(path, language))
    done = apply(spark, edits, sources, create_backup=create_backup, operation_id=operation_id, workspace=files.workspace_root(path) or os.path.dirname(path), validate=validate, **gate)
    return _payload(f"Deleted '{symbol}' and {told['references']} reference(s)", told | {"files": done["files"], "files_modified": len(done["files"])}, done["operation_id"], metadata, done["backup_manifest"])


def run_plan(spark, file: str, **gate) -> dict:
    """Steps in order, each over what the last one left; the first that fails stops the plan and earlier ones stay."""
    folder = os.path.dirname(os.path.abspath(file))
    at = lambda p: p if os.path.isabs(p) else os.path.join(folder, p)
    done = []
    for s in files.read_plan(spark, file).orderBy("step").collect():
        try:
            with open(at(s["with"]), encoding="utf-8") as f:
                new = f.read()
            done.append(patch(spark, at(s.file), s.symbol, new, s.kind, **gate)["message"])
        except (SpanError, OSError, UnicodeDecodeError) as e:
            raise SpanError("PlanExecutionFailed", f"Plan execution failed at step {s.step}: {e}", file=at(s.file)) from e
    return _payload(f"Ran {len(done)} step(s)", {"steps": done})


def undo(spark, manifest: str) -> dict:
    n = backup.restore(manifest)
    return _payload(f"Restored {n} file(s)", {"files_restored": n})


def recover(spark, root: str) -> dict:
    """Complete or take back the commits that a crash has left in a workspace."""
    found = journal.recover(spark, os.path.abspath(root))
    return _payload(f"Recovered {len(found)} commit(s)", {"commits": found})


def apply_files(spark, glob: str, find: str, replace: str, language=None, validate=True, create_backup=False, operation_id=None, metadata=None, **gate) -> dict:
    """A literal replaced in all files that fit a pattern, comments left alone."""
    if not find:
        raise SpanError("Other", "the text to find is empty")
    sources = files.scan_glob(spark, glob, language).persist()
    comments = extract.table(extract.facts(sources), "syntax_nodes").where("kind = 'comment'")
    edits = pattern.replacements(sources, find, replace, comments).persist()
    done = apply(spark, edits, sources, validate=validate, create_backup=create_backup, operation_id=operation_id, **gate)
    total = sum(f["replacements"] for f in done["files"])
    return _payload(f"Replaced {total} match(es) in {len(done['files'])} file(s)", {"files": done["files"], "replacements": total}, done["operation_id"], metadata, done["backup_manifest"])


def query(spark, db: str, label: list[str], listed=False, count=False, show_code=False) -> dict:
    rows = facts.load(spark, db, "entity_labels")
    if listed:
        return _payload("Labels", {"labels": [r.asDict() for r in labels.label_counts(rows).orderBy("label").collect()]})
    if not label:
        raise SpanError("Other", "no label is given", hint="Use --label or --list")
    if count:
        return _payload("Counts", {"counts": [r.asDict() for r in labels.requested_counts(rows, label).orderBy("label").collect()]})
    found = facts.load(spark, db, "symbols").join(labels.all_labels(rows, label), "entity_id").select("entity_id", "name", "kind", "file_path", "byte_start", "byte_end")
    if show_code:
        found = labels.with_code(found, facts.load(spark, db, "code_chunks"))
    return _payload(f"Symbols with {', '.join(label)}", {"symbols": [r.asDict() for r in found.orderBy("file_path", "byte_start").collect()]})


def get(spark, db: str, file: str, start: int, end: int) -> dict:
    row = labels.chunk_at(facts.load(spark, db, "code_chunks"), file, start, end).first()
    if row is None:
        raise not_found(f"{start}..{end}", file)
    return _payload("Code", {"file": file, "start": start, "end": end, "symbol": row.symbol_name, "content": row.content})
