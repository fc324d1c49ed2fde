"""Validation gates: does the rewritten source parse, and does its language's tool accept it."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.errors import SpanError
from lexispan.functions import diagnostics, naming
from lexispan.schema import DIAGNOSTICS
from lexispan.session import ship

#: The tool that checks a language, its arguments before the file, and those that tell its version.
TOOLS = {
    "rust": ("cargo", ["check", "--message-format=short"], ["--version"]), "python": ("python", ["-m", "py_compile"], ["--version"]),
    "c": ("gcc", ["-fsyntax-only"], ["--version"]), "cpp": ("g++", ["-fsyntax-only"], ["--version"]), "java": ("javac", [], ["-version"]),
    "javascript": ("node", ["--check"], ["--version"]), "typescript": ("tsc", ["--noEmit"], ["--version"]),
}


def parse_gate(files: DataFrame, content: str = "after", language: str = "language") -> DataFrame:
    """(file_path, gate, is_valid) of reparsing the texts, by Arrow batches."""
    import pyarrow as pa

    def check(batches):
        from lexispan.parse.symbols import syntax_ok

        for b in batches:
            ok = [syntax_ok((text or "").encode(), lang) for text, lang in zip(b.column("text").to_pylist(), b.column("language").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_path"), pa.array(["parse"] * len(ok)), pa.array(ok, pa.bool_())], ["file_path", "gate", "is_valid"])

    ship(files.sparkSession)
    rows = files.select("file_path", F.col(content).alias("text"), F.col(language).alias("language"))
    return rows.mapInArrow(check, "file_path string, gate string, is_valid boolean")


def tool_metadata(language: str) -> dict:
    """Path and version of a language's tool, null where it is not there."""
    name, _, version = TOOLS[language]
    path = shutil.which(name)
    if not path:
        return {"tool": name, "tool_path": None, "tool_version": None}
    try:
        run = subprocess.run([path, *version], capture_output=True, text=True, timeout=20)
        said = (run.stdout or run.stderr).strip().splitlines()
    except (OSError, subprocess.TimeoutExpired):
        said = []
    return {"tool": name, "tool_path": path, "tool_version": said[0] if said else None}


def run_tool(path: str, language: str, workspace: str | None = None, search: str | None = None) -> tuple[bool, bool, str]:
    """(tool is there, it accepts the file, what it said). Nothing is written beside the source. ``search``: the folders of tools, PATH if none are given."""
    name, before, _ = TOOLS[language]
    tool = shutil.which(name, path=search)
    if not tool:
        return False, True, ""
    with tempfile.TemporaryDirectory() as out:
        args = [tool, *before]
        if language == "java":
            args += ["-d", out]
        if language != "rust":
            args.append(path)
        env = os.environ | {"PYTHONPYCACHEPREFIX": out}
        run = subprocess.run(args, capture_output=True, text=True, cwd=workspace, env=env, timeout=600)
    return True, run.returncode == 0, f"{run.stderr}\n{run.stdout}".strip()


def compiler_gate(spark, paths: list[str], language: str, workspace: str | None = None) -> tuple[list[dict], DataFrame]:
    """Gate results and diagnostics of the language's tool; a missing tool passes, and says so. Executors run it over their files; for Rust the workspace is checked once."""
    import pyarrow as pa

    search = os.environ.get("PATH", os.defpath)

    def check(batches):
        for b in batches:
            own = b.column("file_path").to_pylist()
            said = [run_tool(p, language, workspace, search) for p in own]
            yield pa.RecordBatch.from_arrays([b.column("file_path"), pa.array([x[0] for x in said], pa.bool_()), pa.array([x[1] for x in said], pa.bool_()), pa.array([x[2] for x in said], pa.string())], ["file_path", "tool_available", "is_valid", "output"])

    if language == "rust":
        rows = [(p, *run_tool(p, language, workspace, search)) for p in paths[:1]]
    else:
        ship(spark)
        files = spark.createDataFrame([(p,) for p in paths], "file_path string")
        rows = [tuple(r) for r in files.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInArrow(check, "file_path string, tool_available boolean, is_valid boolean, output string").orderBy("file_path").collect()]
    results = [{"file_path": p, "gate": "compiler", "is_valid": ok, "tool_available": there} for p, there, ok, _ in rows]
    runs = [(p, p, said) for p, _, ok, said in rows if said and not ok]
    if not runs:
        return results, spark.createDataFrame([], DIAGNOSTICS)
    found = diagnostics.PARSERS[language](spark.createDataFrame(runs, "run_id string, file string, output string"))
    return results, with_tool(found, language)


def with_tool(rows: DataFrame, language: str) -> DataFrame:
    """Parsed diagnostics with the tool's path and version, documentation links, and zero places as null."""
    m = tool_metadata(language)
    return rows.select(
        F.lit(m["tool"]).alias("tool"), "level", "message", "file", naming.nonzero("line").alias("line"), naming.nonzero("column").alias("column"), "code", "note",
        F.lit(m["tool_path"]).cast("string").alias("tool_path"), F.lit(m["tool_version"]).cast("string").alias("tool_version"), naming.remediation("code").alias("remediation"),
    )


def analyzer_gate(workspace: str, mode: str) -> None:
    """rust-analyzer over a workspace: off does nothing, os looks it up, another mode is its path; anything it says is a failure."""
    if mode == "off":
        return
    tool = shutil.which("rust-analyzer") if mode in ("os", "path") else (mode if Path(mode).is_file() else None)
    if not tool:
        raise SpanError("AnalyzerNotAvailable", f"rust-analyzer not found: {mode}", hint="Install it, or use --analyzer off")
    run = subprocess.run([tool, "diagnostics", workspace], capture_output=True, text=True, timeout=600)
    said = f"{run.stderr}{run.stdout}".strip()
    if said or run.returncode:
        raise SpanError("AnalyzerFailed", "rust-analyzer reported diagnostics", diagnostics=[{"tool": "rust-analyzer", "level": "error", "message": said}])
