"""How a user's file is written: beside it, to disk, and then by rename."""

from __future__ import annotations

import os
import tempfile

from lexispan.errors import SpanError


def write_atomic(path: str, data: bytes) -> None:
    """Write beside the file, flush to disk, then rename over it."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(prefix=".span-", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(part, os.stat(path).st_mode & 0o7777)
        os.replace(part, path)
    except OSError as e:
        if os.path.exists(part):
            os.unlink(part)
        raise SpanError("Io", f"I/O error for path {path}: {e}", file=path) from e
