"""Backups: copies of files before an operation, a manifest of their hashes, and the way back."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.errors import SpanError
from lexispan.functions.spans import sha256
from lexispan.schema import MANIFEST
from lexispan.session import ship
from lexispan.sources.commit import write_atomic

FOLDER = ".span-backup"


def verified(manifest: DataFrame, copies: DataFrame) -> DataFrame:
    """Manifest rows (original_path, hash, size) with ``status``: ok, missing or mismatch."""
    met = manifest.join(copies.select("original_path", sha256("content").alias("_hash")), "original_path", "left")
    return met.withColumn("status", F.when(F.col("_hash").isNull(), "missing").when(F.col("_hash") != F.col("hash"), "mismatch").otherwise("ok")).drop("_hash")


def _copy(path: str, target: str) -> tuple[str, int]:
    """Copy a file; its hash and size."""
    data = Path(path).read_bytes()
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    write_atomic(target, data)
    return hashlib.sha256(data).hexdigest(), len(data)


def save(workspace: str, paths: list[str], operation_id: str | None = None, spark: SparkSession | None = None) -> tuple[str, str]:
    """Copy files, each once, into the workspace's backup folder; (operation id, path of the manifest). With a session the executors copy, and the driver only lists hashes."""
    op = operation_id or str(uuid.uuid4())
    folder = Path(workspace) / FOLDER / op
    pairs = []
    for p in dict.fromkeys(os.path.abspath(p) for p in paths):
        relative = os.path.relpath(p, workspace)
        if relative.startswith(".."):
            raise SpanError("Other", f"{p} is outside the workspace {workspace}", file=p)
        pairs.append((p, str(folder / relative), relative))
    if spark is None:
        found = [(r, *_copy(p, t)) for p, t, r in pairs]
    else:
        ship(spark)

        def run(batches):
            for b in batches:
                said = [_copy(p, t) for p, t in zip(b.column("path").to_pylist(), b.column("target").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([h for h, _ in said]), pa.array([n for _, n in said])], ["name", "hash", "size"])

        found = [tuple(r) for r in spark.createDataFrame(pairs, "path string, target string, name string").mapInArrow(run, "name string, hash string, size bigint").orderBy("name").collect()]
    folder.mkdir(parents=True, exist_ok=True)
    manifest = folder / "manifest.json"
    files = [{"original_path": name, "hash": h, "size": n} for name, h, n in found]
    manifest.write_text(json.dumps({"operation_id": op, "timestamp": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "files": files}, indent=2))
    return op, str(manifest)


def table(files: DataFrame, operation_id: str) -> DataFrame:
    """The same as rows (op_id, path, hash, size, content), to be appended to a table: for trees too large for one machine."""
    return files.select(F.lit(operation_id).alias("op_id"), F.col("file_path").alias("path"), sha256("content").alias("hash"), F.octet_length("content").cast("bigint").alias("size"), "content")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(operation_id, timestamp, original_path, hash, size) of a manifest's files."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select("operation_id", "timestamp", F.explode("files").alias("f")).select("operation_id", "timestamp", "f.*")


def restore(manifest: str, workspace: str | None = None) -> int:
    """Put all copies back if every one is there and has its hash; else nothing is written."""
    folder = Path(manifest).parent
    try:
        said = json.loads(Path(manifest).read_text())
    except (OSError, ValueError) as e:
        raise SpanError("Io", f"cannot read {manifest}: {e}", file=manifest) from e
    root = Path(workspace) if workspace else folder.parent.parent
    ready = []
    for f in said["files"]:
        copy = folder / f["original_path"]
        if not copy.is_file():
            raise SpanError("Other", f"the backup of {f['original_path']} is missing", file=f["original_path"])
        data = copy.read_bytes()
        if hashlib.sha256(data).hexdigest() != f["hash"]:
            raise SpanError("Other", f"the backup of {f['original_path']} has another hash", file=f["original_path"])
        ready.append((root / f["original_path"], data))
    for path, data in ready:
        write_atomic(str(path), data)
    return len(ready)
