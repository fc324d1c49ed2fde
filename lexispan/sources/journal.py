"""Commits of rewritten files by the executors, all or none, that a restart completes or takes back.

Executors write each new text beside its file and note both; the driver sees names and
hashes only. A marker file is the point of no return: before it a commit is dropped,
after it every file that still waits is renamed into place. Originals stay as links until the
last gate has passed, and a gate that fails puts them back. Each step may run twice, so a
lost executor or driver costs time only. The workspace must be a folder that all executors see.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.errors import SpanError
from lexispan.session import ship
from lexispan.sources.commit import write_atomic

FOLDER = ".span-journal"
ENTRIES = "file_path string, staged string, original string, after_sha256 string, problem string"


def _sha(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _stage_one(path: str, before: str, after: str, op: str) -> tuple[str, str, str, str | None]:
    """Write a new text beside its file: (staged, original, hash, problem). A second run writes the same again."""
    mark = f".span-{op}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    staged, original = (os.path.join(os.path.dirname(path), f"{mark}.{kind}") for kind in ("new", "old"))
    try:
        if _sha(path) != before:
            return staged, original, "", "changed since it was read"
        data = after.encode()
        write_atomic(staged, data)
        os.chmod(staged, os.stat(path).st_mode & 0o7777)
        return staged, original, hashlib.sha256(data).hexdigest(), None
    except (OSError, SpanError) as e:
        return staged, original, "", str(e)


def _place(path: str, staged: str, original: str) -> None:
    """The new text takes its file's place, the original staying as a link; nothing if that is done."""
    if os.path.exists(staged):
        if not os.path.exists(original):
            os.link(path, original)
        os.replace(staged, path)


def _take_back(path: str, staged: str, original: str) -> None:
    """The original stands again, and the new text is gone."""
    if os.path.exists(original):
        os.replace(original, path)
    if os.path.exists(staged):
        os.unlink(staged)


def _clean(path: str, staged: str, original: str) -> None:
    for left in (staged, original):
        if os.path.exists(left):
            os.unlink(left)


def stage(changes: DataFrame, folder: str, op: str) -> DataFrame:
    """Write the new texts of (file_path, before_sha256, after) beside their files; the entries, as they stand in the journal."""
    ship(changes.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(p, *_stage_one(p, h, t, op)) for p, h, t in zip(b.column("file_path").to_pylist(), b.column("before_sha256").to_pylist(), b.column("after").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file_path", "staged", "original", "after_sha256", "problem"])

    changes.select("file_path", "before_sha256", "after").mapInArrow(run, ENTRIES).write.mode("overwrite").parquet(f"{folder}/entries")
    return entries(changes.sparkSession, folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(f"{folder}/entries")


def _on_all(rows: DataFrame, act) -> int:
    """Do something for each entry where it is read; the number of entries."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            for args in zip(*(b.column(c).to_pylist() for c in ("file_path", "staged", "original")), strict=True):
                act(*args)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("file_path", "staged", "original").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _mark(folder: str, name: str, said: dict | None = None) -> None:
    write_atomic(f"{folder}/{name}", json.dumps(said or {}).encode())


def commit(spark: SparkSession, changes: DataFrame, workspace: str, gate=None, operation_id: str | None = None) -> int:
    """Write (file_path, before_sha256, after): all files or, if one has changed meanwhile or the gate fails, none. The number of files."""
    op = operation_id or str(uuid.uuid4())
    folder = os.path.join(workspace, FOLDER, op)
    os.makedirs(folder, exist_ok=True)
    try:
        rows = stage(changes, folder, op)
        bad = rows.where("problem IS NOT NULL").orderBy("file_path").limit(1).collect()
        if bad:
            raise SpanError("Io" if "I/O" in bad[0].problem or "Errno" in bad[0].problem else "Other", f"{bad[0].file_path}: {bad[0].problem}", file=bad[0].file_path)
        _mark(folder, "COMMIT", {"gated": gate is not None})
        n = _on_all(rows, _place)
        if gate is not None:
            gate()
            _mark(folder, "GATED")
    except BaseException:
        _finish(spark, folder, False)
        raise
    _finish(spark, folder, True)
    return n


def _finish(spark: SparkSession, folder: str, done: bool) -> None:
    """Leave the new texts or the originals, and no trace besides."""
    if os.path.isdir(f"{folder}/entries"):
        _on_all(entries(spark, folder), _clean if done else _take_back)
    shutil.rmtree(folder, ignore_errors=True)
    above = Path(folder).parent
    if above.is_dir() and not any(above.iterdir()):
        above.rmdir()


def recover(spark: SparkSession, workspace: str) -> dict[str, str]:
    """What became of each commit that a crash left in a workspace: completed, or taken back.

    With its marker a commit is completed, unless a gate had still to pass; without, it is taken back. Staged texts that
    no entry names, of tasks that ended before their entries were written, go too.
    """
    out = {}
    for folder in sorted(Path(workspace, FOLDER).glob("*")) if Path(workspace, FOLDER).is_dir() else ():
        marker, op = folder / "COMMIT", folder.name
        done = marker.is_file() and (not json.loads(marker.read_text())["gated"] or (folder / "GATED").is_file())
        whole = (folder / "entries" / "_SUCCESS").is_file()
        if done:
            _on_all(entries(spark, str(folder)), _place)
        if whole:
            _finish(spark, str(folder), done)
        else:
            shutil.rmtree(folder, ignore_errors=True)
        for left in Path(workspace).rglob(f".span-{op}-*.new"):
            left.unlink()
        out[op] = "completed" if done else "taken back"
    above = Path(workspace, FOLDER)
    if above.is_dir() and not any(above.iterdir()):
        above.rmdir()
    return out
