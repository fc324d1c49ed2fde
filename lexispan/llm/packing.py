"""Best-fit packing by exact complements.

Pieces count only by length, so a histogram of at most ``size`` lengths holds all
that the plan needs, whatever the corpus. An index of the sums of one, two and
three lengths finds what exactly fills the gap beside a longest length, and such
combinations are consumed while pieces are available: singles first, then pairs,
then triples, the most even ones first, as small pieces are the scarce ones.
Best fit packs what is left. The plan's patterns give, for each length, ranges of ranks
and the places they go to; pieces look theirs up by their rank within the length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import released, ship, written
from lexispan.llm.tokens import encoder, slices

PIECES = "piece int, start long, length long, ids_crc32 long, _part int, _nth long"


class Sums:
    """Lengths that occur, by the sums of one, two and three of them; ``left`` has how many of each are available."""

    def __init__(self, left: np.ndarray):
        self.occurs = left > 0
        self.pairs = [self._larger(s) for s in range(len(left))]
        self.paired = np.array([len(x) > 0 for x in self.pairs])

    def _larger(self, total: int) -> np.ndarray:
        """The larger of each two lengths of this sum, most even first."""
        x = np.arange((total + 1) // 2, total)
        return x[self.occurs[x] & self.occurs[total - x]]

    def _thirds(self, total: int) -> np.ndarray:
        """The smallest of each three lengths of this sum, largest first."""
        x = np.arange(total // 3, 0, -1)
        return x[self.occurs[x] & self.paired[total - x]]

    def pair(self, left: np.ndarray, total: int, least: int = 1) -> tuple[int, ...]:
        """Two available lengths, none under ``least``; none: ()."""
        x = self.pairs[total]
        y = total - x
        at = np.flatnonzero((left[x] > 0) & (left[y] > (x == y)) & (y >= least))
        return (int(x[at[0]]), int(y[at[0]])) if len(at) else ()

    def fill(self, left: np.ndarray, gap: int, number: int) -> tuple[int, ...]:
        """``number`` available lengths that make up the gap; none: ()."""
        if number == 1:
            return (gap,) if left[gap] else ()
        if number == 2:
            return self.pair(left, gap)
        for third in self._thirds(gap).tolist():
            if left[third]:
                left[third] -= 1
                two = self.pair(left, gap - third, third)
                left[third] += 1
                if two:
                    return (*two, third)
        return ()


def exact(sums: Sums, left: np.ndarray, lengths: range, size: int, number: int) -> list[tuple[tuple[int, ...], int]]:
    """Consume from ``left`` combinations of a length of ``lengths`` and ``number`` others that fill a sequence, as patterns."""
    out = []
    for longest in lengths:
        while left[longest]:
            left[longest] -= 1
            rest = sums.fill(left, size - longest, number)
            left[longest] += 1
            if not rest:
                break
            own = (longest, *rest)
            many = {v: own.count(v) for v in own}
            times = min(int(left[v]) // n for v, n in many.items())
            for v, n in many.items():
                left[v] -= n * times
            out.append((own, times))
    return out


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of all pieces, longest first, each in the sequence with the smallest gap that holds it."""
    open_: list[list] = [[] for _ in range(size + 1)]  # by gap: patterns and how many
    for v in range(size, 0, -1):
        n, gap = int(left[v]), v
        while n:
            while gap < size and not open_[gap]:
                gap += 1
            own, times = open_[gap].pop() if gap < size else ((), n)
            # a new sequence takes as many as it can, as they fit each other best
            each = 1 if own else min(size // v, n)
            use = min(times, n // each)
            if use < times and own:
                open_[gap].append((own, times - use))
            open_[(gap if own else size) - each * v].append((own + (v,) * each, use))
            n -= each * use
            gap = max(v, gap - v) if own else v  # what was just put out may be the smallest gap now
    return [x for own in open_ for x in own]


def plan(counts: np.ndarray, size: int, least: int = 32) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of each pattern; counts: available pieces by length 0 to ``size``.

    Exact combinations are taken for a range of longest lengths at once where best fit
    then needs no more sequences for what they leave, else for each of its halves,
    down to ``least`` lengths. So there are never more sequences than by best fit alone.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    sums, patterns = Sums(left), [((size,), int(left[size]))] if left[size] else []
    left[size] = 0

    def sequences(own) -> int:
        return sum(times for _, times in own)

    most = sequences(best_fit(left, size))

    def take(first: int, last: int, number: int) -> None:
        nonlocal left, most
        trial = left.copy()
        own = exact(sums, trial, range(last, first - 1, -1), size, number)
        total = sequences(own) + sequences(best_fit(trial, size)) if own else most
        if total <= most:
            patterns.extend(own)
            left, most = trial, total - sequences(own)
        elif last - first >= least:
            middle = (first + last) // 2
            take(middle + 1, last, number)
            take(first, middle, number)

    for number in (1, 2, 3):
        take(1, size - 1, number)
    return patterns + best_fit(left, size)


def slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset), by rank; a row holds until the next one's first rank."""
    used = np.zeros(size + 1, np.int64)
    rows: dict[int, list] = {}
    sequence = 0
    for lengths, times in patterns:
        at = 0
        for v in lengths:
            rows.setdefault(v, []).append((int(used[v]), sequence, at))
            used[v] += times
            at += v
        sequence += times
    return {v: np.array(x, np.int64) for v, x in rows.items()}


def cut(docs: DataFrame, vocabulary: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids; of a longer document all but the first are full."""
    ship(docs.sparkSession)
    names = ["doc_id", *(x.split()[0] for x in PIECES.split(", ")), *["ids"] * with_ids]

    def pieces(batches):
        encode, nth, part_id = encoder(vocabulary).encode, np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encode(part.column("text"))
                row, piece, start, length, crc, order, body = [], [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    x, k = 0, 0
                    while x < len(own):
                        n = (len(own) - 1) % size + 1 if k == 0 else size
                        data = own[x : x + n].tobytes()
                        row.append(i), piece.append(k), start.append(x), length.append(n), crc.append(zlib.crc32(data)), order.append(int(nth[n]))
                        if with_ids:
                            body.append(data)
                        nth[n] += 1
                        x, k = x + n, k + 1
                doc = part.column("doc_id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc)), pa.array([part_id] * len(row), pa.int32()), pa.array(order, pa.int64()), *[pa.array(body, pa.binary())] * with_ids], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(pieces), f"doc_id long, {PIECES}" + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 1024, with_ids: bool = False, broadcast_rows: int = 100_000) -> DataFrame:
    """Each piece with its sequence_id and offset.

    Null and empty texts are a piece of the end id alone; rows alike, and rows whose
    id is null or repeated, are packed each for itself; other columns are not
    carried. No documents: no pieces. The driver sees the histogram of lengths, at
    most ``size`` rows, and tasks get the plan, whose rows that number bounds too.
    The table of first ranks has a row for each length and task that cut; it is
    broadcast only if it was counted to have at most ``broadcast_rows`` rows.
    """
    found = written(cut(docs, vocabulary, end_id, size, with_ids), "pieces")
    per = found.groupBy("length", "_part").agg(F.count("*").alias("n"))
    per = written(per.withColumn("_base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "bases")
    counts = np.zeros(size + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    table = slots(plan(counts, size), size)
    extra = ["ids"] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *extra]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            where, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                own, rows = np.flatnonzero(length == v), table[int(v)]
                k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                where[own], offset[own] = rows[k, 1] + rank[own] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:5]), pa.array(where), pa.array(offset), *(b.column(c) for c in extra)], names)

    bases = per.select("length", "_part", "_base")
    bases = F.broadcast(bases) if per.count() <= broadcast_rows else bases.hint("merge")
    ranked = found.join(bases, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    return ranked.select(*names[:5], "_rank", *extra).mapInArrow(released(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
