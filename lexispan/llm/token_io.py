"""Token ids in a binary format of their own, packed by an adaptive context-mixing range coder.

A segment holds a run of documents: a table of its ids, rough shares of each, and
blocks. A block starts from that same state whatever precedes it, has a checksum
of its ids, and can be read alone. Inside a block three predictions are mixed for
each id: the id that last followed the two before it (order 2), that which last
followed the one before it (order 1), and the segment's shares (order 0). How
often the first two come true at each level of trust is learnt as the block goes,
and these rates divide the coder's range.

Blocks are coded in step, one id of each at a time, so numpy does the arithmetic
for all of them at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import parts, released, scratch_path, ship
from lexispan.llm.tokens import encoder, flat, slices

MAGIC, VERSION = b"LXID", 2
BLOCK = 1024
#: The range is divided into 2**24; order 0 has at least 2**20 of it, which are the units of the shares.
TOTAL, SHARES = 24, 20
#: Slots of a block's tables by order.
SLOTS = 1024
#: First rates, of 2**16, at each level of trust.
RATES = np.array([0, 4000, 26000, 38000, 46000, 50000, 54000, 58000], np.int32)
#: What orders 1 and 2 can have of the range at most.
_REST = (1 << TOTAL) - (1 << SHARES)

_U = np.uint64


class _Model:
    """State of ``n`` blocks, and the shares of ids 0 to d - 1. All but the coder's range fits 32 bits, which numpy computes twice as fast."""

    def __init__(self, n: int, shares: np.ndarray):
        self.n = n
        self.low = np.concatenate(([0], np.cumsum(shares))).astype(np.uint32)  # of each id, and the total
        self.one, self.two = np.zeros(n * SLOTS, np.int32), np.zeros(n * SLOTS, np.int32)
        self.lane, self.rates = np.arange(n, dtype=np.int64) * SLOTS, np.arange(n, dtype=np.int64) * 8
        self.rate1, self.rate2 = np.tile(RATES, n), np.tile(RATES, n)
        self.before, self.last = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def predict(self):
        """Widths of the ranges for orders 2 and 1, both together, what they leave to order 0, and both predictions plus 1.

        Entries hold (id + 1) * 8 + trust, 1 to 7; 0 is none, of rate 0.
        """
        self.at1 = self.lane + ((self.last * 40503 >> 4) & (SLOTS - 1))
        self.at2 = self.lane + ((self.last * -1640531535 + self.before * 40507 >> 9) & (SLOTS - 1))
        e1, e2 = self.one[self.at1], self.two[self.at2]
        self.trust1, self.trust2 = e1 & 7, e2 & 7
        self.r1, self.r2 = self.rates + self.trust1, self.rates + self.trust2
        self.p1, self.p2 = self.rate1[self.r1], self.rate2[self.r2]
        self.e1, self.e2, id1, id2 = e1, e2, e1 >> 3, e2 >> 3
        w2 = self.p2 * 240
        w1 = (_REST - w2 >> 9) * self.p1 >> 7
        w1 *= id1 != id2
        both = w2 + w1
        return w2, w1, both, (1 << TOTAL) - both, id2, id1

    def order0(self, ids: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ids begin in the range that order 0 has, and how much of it is theirs; wide: that range in 64 bits."""
        a = (self.low[ids] * wide >> SHARES).astype(np.int32)
        return a, (self.low[ids + 1] * wide >> SHARES).astype(np.int32) - a

    def update(self, ids: np.ndarray, same1: np.ndarray, same2: np.ndarray) -> None:
        """same1, same2: the prediction came true. Rates of predictions stay at 8 or more, that of none at 0."""
        new = ids * 8 + 9
        for table, at, e, trust, same, rate, r, p in ((self.one, self.at1, self.e1, self.trust1, same1, self.rate1, self.r1, self.p1), (self.two, self.at2, self.e2, self.trust2, same2, self.rate2, self.r2, self.p2)):
            rate[r] = p + (same * np.int32(65000) - p + 8 >> 4)
            table[at] = np.where(same, e + (trust < 7), np.where(trust > 1, e - (trust + 1 >> 1), new))
        self.before, self.last = self.last, ids


def _chosen(hit2, first, two, one, other) -> np.ndarray:
    """``other``, but ``one`` and ``two`` where the orders of these numbers told the id."""
    np.copyto(other, one, where=first)
    np.copyto(other, two, where=hit2)
    return other


def pack_blocks(ids: np.ndarray, n: int, length: int, shares: np.ndarray) -> list[bytes]:
    """Code n blocks of ``length`` ids each, ids[i, block]."""
    m = _Model(n, shares)
    ids = ids.astype(np.int32)
    low, rng = np.zeros(n, np.uint64), np.full(n, (1 << 56) - 1, np.uint64)
    out = np.zeros((length + 4, n), np.uint32)
    flat, place = out.ravel(), np.arange(n, dtype=np.int64)
    mask, c24, c32, top = _U((1 << 32) - 1), _U(24), _U(32), _U(1 << 32)
    for i in range(length):
        w2, w1, both, w0, id2, id1 = m.predict()
        s = ids[i]
        sym = s + 1
        hit2, hit1 = id2 == sym, id1 == sym
        a, own = m.order0(s, w0.astype(np.uint64))
        first = hit1 > hit2
        r = rng >> c24
        low += r * _chosen(hit2, first, np.int32(0), w2, both + a).view(np.uint32)
        rng = r * _chosen(hit2, first, w2, w1, own).view(np.uint32)
        m.update(s, hit1, hit2)
        small = rng < top
        flat[place] = low >> c32
        place += small * n
        shift = small * c24
        low = np.where(small, low & mask, low) << shift
        rng <<= shift
    for _ in range(3):
        flat[place] = low >> c32
        place += n
        low = (low & mask) << c24
    words = place // n
    while (over := out >> 24).any():  # a carry adds to the word before
        out &= (1 << 24) - 1
        out[:-1] += over[1:]
    body = np.ascontiguousarray(out.T).astype("<u4").view(np.uint8).reshape(n, length + 4, 4)[:, :, :3]
    return [np.ascontiguousarray(body[k, : words[k]]).tobytes() for k in range(n)]


def unpack_blocks(blobs: list[bytes], length: int, shares: np.ndarray) -> np.ndarray:
    """ids[i, block] of blocks of ``length`` ids."""
    n = len(blobs)
    m = _Model(n, shares)
    width = max(len(b) for b in blobs) // 3 + 4
    words = np.zeros((width, n), np.uint32)
    for k, b in enumerate(blobs):
        v = np.frombuffer(b, np.uint8).reshape(-1, 3).astype(np.uint32)
        words[: len(v), k] = v[:, 0] | v[:, 1] << 8 | v[:, 2] << 16
    flat, place = words.ravel(), np.arange(n, dtype=np.int64)
    # the first word has bits 32 to 55 of the code, the next one bits 8 to 31
    code = (flat[place].astype(np.uint64) << _U(32)) | (flat[place + n].astype(np.uint64) << _U(8)) | (flat[place + 2 * n].astype(np.uint64) >> _U(16))
    rng = np.full(n, (1 << 56) - 1, np.uint64)
    lookup = np.repeat(np.arange(len(shares), dtype=np.int32), shares.astype(np.int64))
    place += 2 * n
    out = np.empty((length, n), np.int32)
    last, c24, top = np.int32((1 << TOTAL) - 1), _U(24), _U(1 << 32)
    units = float(1 << SHARES)
    for i in range(length):
        w2, w1, both, w0, id2, id1 = m.predict()
        r = rng >> c24
        v = np.minimum((code // r).astype(np.int32), last)
        hit2, listed = v < w2, v < both
        first = listed > hit2
        wide = w0.astype(np.uint64)
        x = np.maximum(v - both, 0)
        s = lookup[(((x + 1.0) * units - 1.0) / w0).astype(np.int32)]  # both below 2**45: doubles give the exact floor, and divide faster
        a, own = m.order0(s, wide)
        s = _chosen(hit2, first, id2 - 1, id1 - 1, s)
        code -= r * _chosen(hit2, first, np.int32(0), w2, both + a).view(np.uint32)
        rng = r * _chosen(hit2, first, w2, w1, own).view(np.uint32)
        m.update(s, id1 == s + 1, hit2)
        out[i] = s
        small = rng < top
        # 24 more bits: the 16 left of this word and 8 of the next
        more = (flat[place] << np.uint32(8) & np.uint32(0xFFFFFF)) | flat[place + n] >> np.uint32(16)
        shift = small * c24
        code = (code << shift) | more * small
        rng <<= shift
        place += small * n
    return out


def rough_shares(counts: np.ndarray) -> np.ndarray:
    """Shares of the ids by their counts: at least 1 each, 2**SHARES together."""
    if len(counts) > 1 << SHARES - 1:
        raise ValueError("too many different ids for one segment")
    c = np.maximum(counts.astype(np.float64), 1)
    s = np.maximum(1, np.floor(c / c.sum() * ((1 << SHARES) - len(c)))).astype(np.int64)
    s[np.argmax(s)] += (1 << SHARES) - s.sum()
    return s


def segment(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> bytes:
    """The documents' ids, one after another, as a segment; doc_ids (null: the mask's place) and their numbers of ids stand in its header."""
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    number = np.zeros(len(counts), np.int64)
    number[known] = np.arange(len(known))
    sym = number[ids]
    shares = rough_shares(counts[known]) if len(known) else np.zeros(0, np.int64)
    n = len(ids) // block
    blobs = pack_blocks(np.ascontiguousarray(sym[: n * block].reshape(n, block).T), n, block, shares) if n else []
    if rest := len(ids) - n * block:
        blobs += pack_blocks(sym[n * block :].reshape(-1, 1), 1, rest, shares)
    crc = [zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)]
    head = zlib.compress(b"".join((np.diff(known, prepend=0).astype("<u4").tobytes(), shares.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), np.array([len(b) for b in blobs], "<u4").tobytes(), np.array(crc, "<u4").tobytes())), 1)
    return b"".join((MAGIC, struct.pack("<HIIIIII", VERSION, block, len(ids), len(known), len(doc_ids), len(blobs), len(head)), struct.pack("<I", zlib.crc32(head)), head, *blobs))


def read_segment(data: bytes, only: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, sizes); with ``only`` just those blocks' ids. A wrong checksum raises."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    version, block, total, d, n_docs, n_blocks, n_head = struct.unpack_from("<HIIIIII", data, 4)
    (crc_head,) = struct.unpack_from("<I", data, 30)
    head = data[34 : 34 + n_head]
    if version != VERSION or zlib.crc32(head) != crc_head:
        raise ValueError("a damaged segment header")
    head = zlib.decompress(head)
    parts_, at = [], 0
    for n, kind in ((d, "<u4"), (d, "<u4"), (n_docs, "<i8"), (n_docs, "<u4"), (n_blocks, "<u4"), (n_blocks, "<u4")):
        parts_.append(np.frombuffer(head, kind, n, at))
        at += n * np.dtype(kind).itemsize
    known, shares, doc_ids, sizes, lengths, crc = parts_
    known = np.cumsum(known, dtype=np.int64)
    ends = 34 + n_head + np.cumsum(lengths.astype(np.int64))
    blobs = [data[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    want = list(range(n_blocks)) if only is None else only
    whole = [k for k in want if (k + 1) * block <= total]
    last = [k for k in want if (k + 1) * block > total]
    out: dict[int, np.ndarray] = {}
    for own, length in ((whole, block), (last, total % block)):
        if own:
            got = known[unpack_blocks([blobs[k] for k in own], length, shares.astype(np.int64))]
            for j, k in enumerate(own):
                out[k] = np.ascontiguousarray(got[:, j]).astype("<u4")
                if zlib.crc32(out[k].tobytes()) != crc[k]:
                    raise ValueError(f"block {k} has a wrong checksum")
    return np.concatenate([out[k] for k in want]) if want else np.zeros(0, "<u4"), doc_ids, sizes


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, segment_ids: int = 3 << 20) -> None:
    """Encode whole texts (null: empty), end each with ``end_id``, and write segments in ascending order of doc_id under ``path``.

    Null ids come first; rows that share an id stand beside each other, by their token ids.
    Segments are rows of a table of one binary column, so any store that Spark
    writes to will do: (part, nth) order them, ``tokens`` counts their ids.

    Texts are encoded where they are read, and their ids dealt out by ranges of doc_id, which a scan
    of that column alone gives: ranges of about as many documents each, unless ids repeat.
    """
    spark = docs.sparkSession
    ship(spark)
    n = parts(spark)
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    cuts = docs.select(doc_id).agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.array(cuts[: n - 1], np.int64)
    kind = np.dtype("<u2" if len(encoder(vocabulary).marks) <= 1 << 16 else "<u4")

    def encoded(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                ids, at = encode(piece.column("text"))
                doc = piece.column("doc_id")
                place = np.searchsorted(bounds, doc.fill_null(0).to_numpy(), "right").astype(np.int32)
                place[np.asarray(doc.is_null())] = 0
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at * kind.itemsize), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([doc, pa.array(place), body.cast(pa.binary())], ["doc_id", "place", "ids"])

    def segments(batches):
        from pyspark import TaskContext

        part_id, nth = TaskContext.get().partitionId(), 0
        held_ids, held_docs, held_sizes, held_null, held = [], [], [], [], 0

        def put():
            nonlocal nth, held
            doc = np.concatenate(held_docs)
            body = segment(np.concatenate(held_ids), doc, np.concatenate(held_sizes))
            row = pa.RecordBatch.from_arrays([pa.array([part_id], pa.int32()), pa.array([nth], pa.int32()), pa.array([held], pa.int64()), pa.array([int(sum(held_null))], pa.int64()), pa.array([body], pa.binary())], ["part", "nth", "tokens", "nulls", "body"])
            nth, held = nth + 1, 0
            for x in (held_ids, held_docs, held_sizes, held_null):
                x.clear()
            return row

        for batch in batches:
            for piece in slices(batch, "ids", 8 << 20):
                data, at = flat(piece.column("ids"))
                n = np.diff(at) // kind.itemsize + 1
                out = np.full(int(n.sum()), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(n) - 1] = False
                out[keep] = np.frombuffer(data, kind)
                doc = piece.column("doc_id")
                held_ids.append(out), held_sizes.append(n), held_null.append(doc.null_count)
                held_docs.append(doc.fill_null(0).to_numpy())
                held += len(out)
                if held >= segment_ids:
                    yield put()
        if held:
            yield put()

    rows = docs.select(doc_id, "text").mapInArrow(released(encoded), "doc_id long, place int, ids binary")
    dealt = rows.repartitionById(n, "place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    dealt.select("doc_id", "ids").mapInArrow(released(segments), "part int, nth int, tokens long, nulls long, body binary").write.option("compression", "none").parquet(path)


def read(spark, path: str, with_ids: bool = False, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, and ``ids`` as little-endian numbers on demand.

    Where segments begin goes to the tasks, so their bodies stay where they are read,
    if the segments were counted to be at most ``broadcast_rows``; else both are shuffled.
    """
    ship(spark)
    table = spark.read.schema("part int, nth int, tokens long, nulls long, body binary").parquet(path)
    # where segments begin: sums over parts, then inside each
    whole = table.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = whole.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table.select("part", "nth", inside.alias("inside")).join(before, "part").select("part", "nth", (F.col("base") + F.col("inside")).alias("base"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def documents(batches):
        for b in batches:
            for base, nulls, body in zip(b.column("base").to_pylist(), b.column("nulls").to_pylist(), b.column("body"), strict=True):
                ids, doc, sizes = read_segment(body.as_py())
                ends = np.cumsum(sizes.astype(np.int64))
                data, first = ids.tobytes(), ends - sizes
                bodies = [data[4 * a : 4 * e] for a, e in zip(first.tolist(), ends.tolist(), strict=True)]
                null = np.arange(len(doc)) < nulls
                yield pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64), mask=null), pa.array(first + base), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in bodies], pa.int64()), *[pa.array(bodies, pa.binary())] * with_ids], names)

    starts = F.broadcast(starts) if table.select("nth").limit(broadcast_rows + 1).count() <= broadcast_rows else starts
    rows = table.select("part", "nth", "nulls", "body").join(starts, ["part", "nth"]).select("base", "nulls", "body")
    return rows.mapInArrow(released(documents), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write the files into the shared folder and read them again."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path)
