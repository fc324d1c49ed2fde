"""Scripts of edits, each step over what the one before left, composed into edits of the first text.

A file's state is a list of pieces: stretches of its first text, and new texts. A step's
spans are places in the text as it then is; running sums of the pieces' lengths turn
them into cuts of pieces. After the last step the new texts between kept stretches
are the edits. Texts are met once, when these are applied; a step costs its edits
and the pieces, not the text.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.operators.rewrite import rewritten
from lexispan.session import ship

#: (start, end, None) in the first text, or (0, length, bytes) of a new one.
Piece = tuple[int, int, bytes | None]


def _between(pieces: list[Piece], ends: list[int], a: int, b: int) -> list[Piece]:
    """The pieces of [a, b) of the present text."""
    out = []
    k = bisect_right(ends, a)
    while a < b:
        x, y, new = pieces[k]
        begin = ends[k] - (y - x)
        upto = min(b, ends[k])
        if upto > a:
            out.append((x + a - begin, x + upto - begin, new))
        a, k = upto, k + 1
    return out


def composed(steps: list[list[tuple[int, int, bytes]]], length: int) -> list[tuple[int, int, bytes]]:
    """Edits (start, end, new) of the first text, in order and apart, that do what the steps do one after another.

    A step's edits are apart from each other, as of the text before the step; ValueError names a step whose edits are not, or
    leave the text.
    """
    pieces: list[Piece] = [(0, length, None)] if length else []
    for n, edits in enumerate(steps):
        ends = list(accumulate(y - x for x, y, _ in pieces))
        total, at, out = ends[-1] if ends else 0, 0, []
        for a, b, new in sorted(edits):
            if not at <= a <= b <= total:
                raise ValueError(f"step {n}: the span ({a}, {b}) overlaps another or leaves the text")
            out += _between(pieces, ends, at, a)
            if new:
                out.append((0, len(new), new))
            at = b
        pieces = out + _between(pieces, ends, at, total)
    done, at, new = [], 0, b""
    for x, y, body in [*pieces, (length, length, None)]:
        if body is not None:
            new += body[x:y]
        else:
            if new or x > at:
                done.append((at, x, new))
            at, new = y, b""
    return done


def compose(script: DataFrame, files: DataFrame) -> DataFrame:
    """Replacements (batch_no, ordinal, file_path, byte_start, byte_end, content) of the first texts, and ``problem``, null or why a file's script cannot be done.

    script: file_path, step, byte_start, byte_end, content. Only the edits and the texts' lengths are
    shuffled; a file's edits are one task's. A file with a problem has one row and no edits.
    """
    ship(script.sparkSession)
    key = script.schema["file_path"].dataType
    lengths = files.select("file_path", F.octet_length("content").cast("bigint").alias("_length"))
    rows = script.select("file_path", F.struct(F.col("step").cast("bigint").alias("step"), F.col("byte_start").cast("bigint").alias("a"), F.col("byte_end").cast("bigint").alias("b"), F.col("content").alias("new")).alias("e"))
    per = rows.groupBy("file_path").agg(F.sort_array(F.collect_list("e")).alias("edits")).join(lengths, "file_path", "left")

    def make(batches):
        for batch in batches:
            own, out = batch.column("file_path"), ([], [], [], [], [], [])
            for i, (edits, length) in enumerate(zip(batch.column("edits").to_pylist(), batch.column("_length").to_pylist(), strict=True)):
                steps: dict[int, list] = {}
                for e in edits:
                    steps.setdefault(e["step"], []).append((e["a"], e["b"], (e["new"] or "").encode()))
                try:
                    if length is None:
                        raise ValueError("the file is missing")
                    found = [(k, a, b, new.decode(), None) for k, (a, b, new) in enumerate(composed(list(steps.values()), length))]
                except ValueError as e:  # edits that a script cannot make, or that cut a character of a new text
                    found = [(0, None, None, None, str(e))]
                for row in found:
                    for column, x in zip(out, (i, *row), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(take), pa.int64()), pa.array(out[1], pa.int64()), own.take(take), *(pa.array(c, k) for c, k in zip(out[2:], kinds[1:], strict=True))], ["batch_no", "ordinal", "file_path", "byte_start", "byte_end", "content", "problem"])

    return per.mapInArrow(make, f"batch_no bigint, ordinal bigint, file_path {key.simpleString()}, byte_start bigint, byte_end bigint, content string, problem string")


def scripted(script: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, before, after, before_sha256, after_sha256, n_edits) of each file after all its steps, the text met once; files with a problem have no row."""
    return rewritten(compose(script, files).where("problem IS NULL").drop("problem"), files)
