"""Periodic runs of words by divide and conquer in the manner of Main and Lorentz.

A run that is not inside one half of a stretch crosses its middle, and then holds a
whole period to the left or to the right of it. How far the words on both sides
agree with those one period on is read from Z-functions of the halves, for all
periods at once. Each run is found entire at the highest stretch whose middle it
crosses; what lower stretches see of it is cut by their borders, can be extended and
goes. Of the periods of one interval the smallest stays.

A run of at least 24 words and three periods repeats 16 words one period on. So a
stretch in which no 16 words repeat (by a hash, whose collisions only cost time)
holds no run, and is not divided further.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexispan.llm.common import released, ship
from lexispan.llm.tokens import flat, slices
from lexispan.llm.words import interned

#: Least words, and least periods, of a run.
WORDS, PERIODS = 24, 3
#: Words that each such run repeats one period on: two thirds of the least.
GRAM = WORDS - WORDS // PERIODS

Run = tuple[int, int, int]


def agreements(s: list[int]) -> list[int]:
    """The Z-function: how many items from each place on are those that the list begins with."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: list[int], low: int, high: int) -> list[Run]:
    """(start, end, period) of the repetitions across the middle of w[low:high] that are long enough, as far as they go inside it."""
    middle = (low + high) // 2
    left, right = w[low:middle], w[middle:high]
    most = (high - low) // PERIODS
    a, b = min(most, len(left)), min(most, len(right))
    ahead = np.array(agreements([*right, -1, *left[len(left) - a :], *right]))
    mirrored = left[::-1]
    behind = np.array(agreements([*mirrored, -1, *right[:b][::-1], *mirrored]))
    found = []
    for p, start, end in (
        # the whole period lies before the middle: words from a period back agree with those of the right half
        (p := np.arange(1, a + 1), middle - p - behind[p], middle + ahead[len(right) + 1 + a - p]),
        # or after it: words up to a period on agree with those of the left half
        (p := np.arange(1, b + 1), middle - behind[len(left) + 1 + b - p], middle + p + ahead[p]),
    ):
        ok = end - start >= np.maximum(WORDS, PERIODS * p)
        found += zip(start[ok].tolist(), end[ok].tolist(), p[ok].tolist(), strict=True)
    return found


def next_alike(ids: np.ndarray) -> np.ndarray:
    """For each place with GRAM words from it on: where the same words, by a hash, come next; beyond the end if nowhere."""
    n = len(ids) - GRAM + 1
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < GRAM:  # twice as many words each time
        h = h[:-width] * np.uint64(0xBF58476D1CE4E5B9) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h = h[:n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.full(n, len(ids), np.int64)
    out[order[:-1][same]] = order[1:][same]
    return out


def runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs of numbered words, by start, then period."""
    n = len(ids)
    if n < WORDS:
        return []
    after = next_alike(ids)
    if (after == n).all():
        return []
    w, least = ids.tolist(), {}
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low < WORDS or not (after[low : high - GRAM + 1] <= high - GRAM).any():
            continue
        for start, end, p in crossing(w, low, high):
            if (start and w[start - 1] == w[start - 1 + p]) or (end < n and w[end] == w[end - p]):
                continue  # cut by a border: found entire above
            least[start, end] = min(p, least.get((start, end), p))
        middle = (low + high) // 2
        todo += ((low, middle), (middle, high))
    return sorted((start, end - start, p) for (start, end), p in least.items())


def stretched(words: list[bytes], ids: np.ndarray, doc_id: int | None) -> tuple[list[bytes], np.ndarray]:
    """The words of which the query asks for runs: of every tenth id, by its checksum, they repeat from some word on."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words, ids
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return [words[i] for i in at.tolist()], ids[at]


def without_repeats(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    drop = np.zeros(len(words), bool)
    for start, length, p in found:
        drop[start + p : start + length] = True
    return [w for w, d in zip(words, drop.tolist(), strict=True) if not d] if found else words


def find(docs: DataFrame, stretch: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs as structs (start, length, period), and its words without the repeats, joined by spaces.

    Null texts, like empty ones, have no words and no runs, and ``collapsed`` is empty;
    a null id stays null and is never stretched; repeated rows are rows each; other
    columns are not read. A text is one task's, in time n log n and memory linear in it.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = flat(part.column("text"))
                body, sizes, rows, kept = data.tobytes(), [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    words, ids = interned(body[a:b])
                    if stretch:
                        words, ids = stretched(words, ids, part.column("doc_id")[i].as_py())
                    own = runs(ids)
                    sizes.append(len(words))
                    rows.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    kept.append(b" ".join(without_repeats(words, own)).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(released(searched), schema)


def digest(found: DataFrame) -> DataFrame:
    """Of each row of ``find`` the number of its runs, the run of greatest length by period (ties: smallest start, then period; none: nulls), and checksums of its runs and of what is left of its words."""
    ship(found.sparkSession)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def told(batches):
        for b in batches:
            columns: list[list] = [[] for _ in names]
            for doc, own, kept in zip(b.column("doc_id").to_pylist(), b.column("runs").to_pylist(), b.column("collapsed").to_pylist(), strict=True):
                rows = [(r["start"], r["length"], r["period"]) for r in own]
                best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in rows)
                milli = best and 1000 * best[1] // best[2]
                row = (doc, len(rows), *(best or (None, None, None)), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return found.select("doc_id", "runs", "collapsed").mapInArrow(released(told), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
