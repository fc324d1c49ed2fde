"""Suffix-array removal of byte strings that start more than once, by a merge sort that minds common prefixes.

Sorting every suffix of a corpus would move each text hundreds of times over, so
a sparse suffix array is sorted whose suffixes are chosen by content: of the
64-byte grams that begin in a string of the wanted length, that with the smallest
hash is its anchor, wherever the string stands (winnowing). Every repeated string
so has, in all its copies, an anchor at one distance d from its start. Grams that
occur once cannot lie in a repeat and go no further.

Around each other anchor stands its context: the bytes from it on (up to the
length), and those before it, last first. Tasks sort their contexts into
front-coded runs, contexts that are alike become one with a count, and each
reducer merges its runs with a loser tree that starts each comparison after the
prefix that both sides share with the last winner. Common prefixes of neighbours
then tell, for each d, which anchors agree in the length - d bytes that follow;
those that agree in the d bytes before too hold the same string.

Contexts of a gram that occurs often are put together before they are dealt. If more
of them differ than a reducer should hold, the gram is split by content. The
distances d are cut into ranges; strings of a range share the bytes that all of
them cover, so only contexts whose shared bytes occur twice can repeat there, and
these, trimmed to the range, are dealt by the shared bytes and merged as others
are. Where shared bytes occur too often for a reducer, each string is dealt by
itself, and alike ones are one before they meet.

Passages of so many words that have fewer bytes than the length are strings of
the same kind, of several lengths: each has the smallest gram inside it as its
anchor, lies inside that anchor's context, and is told by its hash.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import discard, parts, released, ship, written
from lexispan.llm.tokens import flat, slices

GRAM = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_B = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_B, pow(_B, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram at each place where one fits."""
    n = len(data)
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    total = np.cumsum(_TABLE[data] * up[:n], dtype=np.uint64)
    h = total[gram - 1 :].copy()
    h[1:] -= total[: n - gram]
    h *= down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each w values in a row."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def passage_anchors(data: np.ndarray, offsets: np.ndarray, length: int, words: int, gram: int = GRAM) -> np.ndarray:
    """Places of the anchors, first of the smallest, of all passages of ``words`` words and fewer than ``length`` bytes inside the texts."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.int64)
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    if len(begins) < words:
        return np.zeros(0, np.int64)
    first, last = begins[: len(begins) - words + 1], ends[words - 1 :]
    use = (last - first < length) & (last - first >= gram) & (np.searchsorted(offsets, first, "right") == np.searchsorted(offsets, last, "left"))
    first, width = first[use], (last - first)[use] - gram + 1
    x = (gram_hashes(data, gram) >> np.uint64(32) << np.uint64(32)) | np.arange(n - gram + 1, dtype=np.uint64)
    out, size = [np.zeros(0, np.int64)], 1
    while size < length:
        now = (width >= size) & (width < 2 * size)
        if now.any():
            out.append((np.minimum(x[first[now]], x[first[now] + width[now] - size]) & np.uint64(0xFFFFFFFF)).astype(np.int64))
        if len(x) <= size:
            break
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.unique(np.concatenate(out))


def passages(line: bytes, at: int, length: int, words: int, most: int, gram: int = GRAM) -> list[tuple[int, int]]:
    """(d, m) of the passages of fewer than ``length`` bytes around the gram at ``at``: from d bytes before it to m bytes, at most ``most``, after its start."""
    found = [x.span() for x in _WORD.finditer(line)]
    return [(at - x, y - at) for (x, _), (_, y) in zip(found, found[words - 1 :], strict=False) if x <= at and gram <= y - at <= most and y - x < length]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of ``length`` bytes inside the texts, and of passages of ``words`` words if any are asked for, and their grams' hashes."""
    if words:
        own, h = anchors(data, offsets, length, gram)
        own = np.union1d(own, passage_anchors(data, offsets, length, words, gram)).astype(np.int64)
        return own, gram_hashes(data, gram)[own] if len(own) else h
    n, w = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    g = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 marks strings that cross texts
    low = _sliding(g, w, np.minimum)  # for each start of a string
    inside = np.ones(n + 1, bool)
    ends = offsets[1:-1]
    for e in ends[(ends > 0) & (ends < n)].tolist():  # strings that would cross from text to text
        inside[max(0, e - length + 1) : e] = False
    low = np.where(inside[: len(low)], low, np.uint32(0))
    padded = np.concatenate((np.zeros(w - 1, np.uint32), low, np.zeros(w - 1, np.uint32)))
    high = _sliding(padded, w, np.maximum)[: len(g)]
    # a gram may be the least of a string inside one text only
    own = np.flatnonzero((high == g) & (high > 0))
    return own, h[own]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Bytes that a and b share from the start, of which ``known`` are known."""
    most = min(len(a), len(b))
    while known < most:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            n = min(len(x), len(y))
            diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return known + (n if not diff else n - (diff.bit_length() + 7) // 8)
        known += len(x)
    return most


def front_coded(items: list[tuple]) -> bytes:
    """A sorted run of (context, right bytes, left bytes, count, c1, c2) with each context cut after the prefix that it shares with the one before."""
    import pickle

    last, out = b"", []
    for s, r, left, n, c1, c2 in items:
        k = common_prefix(last, s, 0)
        out.append((k, s[k:], r, left, n, c1, c2))
        last = s
    return pickle.dumps(out, protocol=5)


class _Run:
    """Reads a front-coded run; lcp: bytes that the head shares with what was put out last."""

    __slots__ = ("rest", "head", "lcp", "more")

    def __init__(self, blob: bytes):
        import pickle

        self.rest, self.head, self.lcp, self.more = iter(pickle.loads(blob)), b"", 0, ()
        self.step()

    def step(self) -> None:
        item = next(self.rest, None)
        if item is None:
            self.head = None
        else:
            self.lcp, s, *self.more = item
            self.head = self.head[: self.lcp] + s


def merged(blobs: list[bytes]):
    """(shared prefix with the one before, context, right, left, count, c1, c2) of all runs in order, by a loser tree.

    Both players know how many bytes they share with the last winner. Unequal
    numbers decide without looking at a byte: the longer one is smaller. Equal ones
    need a comparison from that place on, and the loser keeps what it found.
    """
    runs = [_Run(b) for b in blobs]
    size = 1
    while size < len(runs):
        size *= 2
    tree: list[_Run | None] = [None] * size

    def play(a: _Run | None, b: _Run | None) -> tuple[_Run | None, _Run | None]:
        """Winner and loser."""
        if a is None or a.head is None:
            return b, a
        if b is None or b.head is None:
            return a, b
        if a.lcp != b.lcp:
            return (a, b) if a.lcp > b.lcp else (b, a)
        k = common_prefix(a.head, b.head, a.lcp)
        if k == len(a.head) or (k < len(b.head) and a.head[k] < b.head[k]):
            b.lcp = k
            return a, b
        a.lcp = k
        return b, a

    def build(node: int) -> _Run | None:
        if node >= size:
            return runs[node - size] if node - size < len(runs) else None
        win, tree[node] = play(build(2 * node), build(2 * node + 1))
        return win

    place = {id(r): i + size for i, r in enumerate(runs)}
    if not runs:
        return
    for r in runs:
        r.lcp = 0
    win = build(1) if size > 1 else runs[0]
    while win is not None and win.head is not None:
        yield win.lcp, win.head, *win.more
        win.step()
        node, up = place[id(win)] // 2, win
        while node:
            up, tree[node] = play(up, tree[node])
            node //= 2
        win = up


def repeated_passages(items: list[list], length: int, words: int) -> dict[int, list[int]]:
    """By item: d and m of the passages that stand in other contexts too, or in one that counts twice."""
    from xxhash import xxh64_intdigest

    share = [x[0] for x in items] + [0]
    out: dict[int, list[int]] = {}
    key, of, d, m = [], [], [], []
    for i, (_, s, r, _, n, *_) in enumerate(items):
        near = max(share[i], share[i + 1]) if i else share[1]  # contexts in order: what others share, a neighbour does
        if n < 2 and near < GRAM:
            continue
        line = s[r:][::-1] + s[:r]
        for x, y in passages(line, len(s) - r, length, words, r if n > 1 else near):
            if n > 1:
                out.setdefault(i, []).extend((x, y))
            if y <= near:
                key.append(xxh64_intdigest(line[len(s) - r - x : len(s) - r + y], x)), of.append(i), d.append(x), m.append(y)
    if key:
        k = np.array(key, np.uint64)
        _, back, count = np.unique(k, return_inverse=True, return_counts=True)
        for j in np.flatnonzero(count[back] > 1).tolist():
            out.setdefault(of[j], []).extend((d[j], m[j]))
    return out


def packed_spans(levels: np.ndarray, own: list[int]) -> bytes:
    """Bits of the levels, then d and m of passages."""
    return np.packbits(levels, bitorder="little").tobytes() + np.array(own, "<u2").tobytes()


def repeated_levels(items: list[list], length: int, reach: int, words: int = 0) -> list[tuple[int, int, bytes]]:
    """(c1, c2, bits) of the contexts with repeated strings; bit d: the string that starts d bytes before the anchor; d and m of passages follow.

    items: (lcp, context, right, left, count, c1, c2) in order, distinct contexts, each with the prefix shared with the one before.
    """
    n = len(items)
    lcp = np.fromiter((x[0] for x in items), np.int64, n)
    right, left = np.fromiter((x[2] for x in items), np.int64, n), np.fromiter((x[3] for x in items), np.int64, n)
    many = np.fromiter((x[4] > 1 for x in items), bool, n)
    near = np.zeros(n, bool)  # shares enough with a neighbour
    near[1:] = lcp[1:] >= length - reach
    near[:-1] |= near[1:]
    hit = np.zeros((n, reach + 1), bool)
    levels = np.arange(reach + 1)
    hit[many] = (levels <= left[many, None]) & (levels >= length - right[many, None])
    own = np.flatnonzero(near)
    if len(own):
        before = np.frombuffer(b"".join(items[i][1][items[i][2] :].ljust(reach, b"\0")[:reach] for i in own), np.uint8).reshape(len(own), reach).T.copy()
        r, lf, share = right[own], left[own], lcp[own].copy()
        share[np.flatnonzero(np.diff(own) > 1) + 1] = 0
        share[0] = 0
        h = np.zeros(len(own), np.uint64)
        for d in range(reach + 1):
            if d:
                h = h * np.uint64(_B) + _TABLE[before[d - 1]]
            m = length - d
            ok = np.flatnonzero((r >= m) & (lf >= d))
            if len(ok) < 2:
                continue
            group = np.cumsum(share < m).astype(np.uint64)[ok]
            key = (group * np.uint64(0xD6E8FEB86659FD93)) ^ (h[ok] ^ (h[ok] >> np.uint64(29)))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            two = np.zeros(len(ok), bool)
            two[order[1:][same]] = True
            two[order[:-1][same]] = True
            hit[own[ok[two]], d] = True
    own = repeated_passages(items, length, words) if words else {}
    some = np.flatnonzero(hit.any(axis=1)).tolist()
    return [(items[i][5], items[i][6], packed_spans(hit[i], own.get(i, []))) for i in sorted({*some, *own})]


def ranges(length: int, reach: int, number: int = 8) -> list[tuple[int, int]]:
    """The distances 0 to ``reach`` in ``number`` ranges, first and last."""
    edges = [(reach + 1) * i // number for i in range(number + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def shared_bytes(line: bytes, left: int, length: int, cuts: list[tuple[int, int]]) -> list[tuple[int, bytes]]:
    """(-1 - number, bytes) of each range of distances whose strings the context could hold: what all its strings cover."""
    return [(-1 - i, line[left - lo : left + length - hi]) for i, (lo, hi) in enumerate(cuts) if lo <= left and length - hi <= len(line) - left]


def trimmed(line: bytes, left: int, length: int, lo: int, hi: int) -> tuple[bytes, int, int]:
    """(context, right, left) that holds the strings of the distances lo to hi and no more."""
    before, after = line[max(0, left - hi) : left], line[left : left + length - lo]
    return after + before[::-1], len(after), len(before)


def _digest(s: bytes, r: int) -> tuple[int, int]:
    d = hashlib.blake2b(s, digest_size=16, salt=r.to_bytes(4, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def spans(docs: DataFrame, length: int = 400, each: int = 40_000, hot: int = 40_000, words: int = 0) -> DataFrame:
    """(k1, k2, spans) of the documents with repeated strings, or passages of ``words`` words, spans being (start, end, short) in bytes, in no order; short ones are passages.

    k1 and k2 name a document: its id (null: -1) and its text's hash. ``each``:
    about as many contexts meet in a reducer. Grams that occur over ``hot`` times are
    put together first, and if over ``hot`` of their contexts differ, they are split by
    content; so are ranges whose shared bytes over ``hot`` contexts hold.
    """
    spark = docs.sparkSession
    ship(spark)
    reach = length - GRAM
    cuts = ranges(length, reach)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64("text").alias("k2"), "text").where(F.octet_length("text") >= (min(length, max(GRAM, 2 * words - 1)) if words else length))

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, offsets = flat(part.column("text"))
                at, h = anchors(data, offsets, length, words=words)
                row = np.searchsorted(offsets, at, "right") - 1
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("k1").take(take), part.column("k2").take(take), pa.array((at - offsets[row]).astype(np.int32)), pa.array(h.view(np.int64))], ["k1", "k2", "pos", "gram"])

    found = written(keyed.mapInArrow(released(find), "k1 long, k2 long, pos int, gram long"), "anchors")
    twice = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_parts = max(parts(spark), total // each)
    # a set: rows alike have the same places, which stand once however many rows there are
    places = found.join(twice, "gram").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "gram", (F.col("n") > hot).alias("hot"))).alias("places"))
    kinds = "kind int, part long, c1 long, c2 long, k1 long, k2 long, pos int, blob binary, n long"
    names = [x.split()[0] for x in kinds.split(", ")]

    def rows(kind, part, c1, c2, k1, k2, pos, blob, n):
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int64()), *(pa.array(v, pa.int64()) for v in (c1, c2, k1, k2)), pa.array(pos, pa.int32()), pa.array(blob, pa.binary()), pa.array(n, pa.int64())], names)

    def runs_out(runs, task):
        """Kind 1: sorted runs, by reducer."""
        for part, own in runs.items():
            items = sorted((s, r, left, n, c1, c2) for (s, r), (left, n, c1, c2) in own.items())
            for at in range(0, len(items), 20_000):
                yield rows(1, [part], [task], [0], [0], [0], [0], [front_coded(items[at : at + 20_000])], [len(items[at : at + 20_000])])

    def hot_out(crowd):
        """Kind 3: contexts of grams that occur often, with the gram as part."""
        items = list(crowd.items())
        for at in range(0, len(items), 5000):
            own = items[at : at + 5000]
            yield rows(3, [v[4] for _, v in own], [v[2] for _, v in own], [v[3] for _, v in own], [v[0] for _, v in own], [0] * len(own), [k[1] for k, _ in own], [k[0] for k, _ in own], [v[1] for _, v in own])

    def contexts(batches):
        """Kind 0: members of contexts; then what their grams' kinds ask for."""
        task = TaskContext.get().partitionId()
        runs: dict[int, dict] = {}
        crowd: dict[tuple, list] = {}
        held = 0
        for batch in batches:
            member: list[list] = [[], [], [], [], []]
            for k1, k2, text, own in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("places").to_pylist(), strict=True):
                text = text.as_py()
                for p in own:
                    a, part = p["pos"], p["gram"] % n_parts
                    after, before = text[a : a + length], text[max(0, a - reach) : a]
                    s, r = after + before[::-1], len(after)
                    where = crowd if p["hot"] else runs.setdefault(part, {})
                    seen = where.get((s, r))
                    if seen:
                        seen[1] += 1
                    else:
                        seen = where[s, r] = [len(before), 1, *_digest(s, r), *[p["gram"]] * p["hot"]]
                        held += len(s)
                    for m, v in zip(member, (seen[2], seen[3], k1, k2, a), strict=True):
                        m.append(v)
                if len(member[0]) > 50_000:
                    yield rows(0, [0] * len(member[0]), *member, [None] * len(member[0]), [0] * len(member[0]))
                    member = [[], [], [], [], []]
            yield rows(0, [0] * len(member[0]), *member, [None] * len(member[0]), [0] * len(member[0]))
            if held > 24 << 20:
                yield from runs_out(runs, task)
                yield from hot_out(crowd)
                runs, crowd, held = {}, {}, 0
        yield from runs_out(runs, task)
        yield from hot_out(crowd)

    # a row that stands twice, as its key then does, has each place twice; all places of a key go to each of its rows
    mixed = written(keyed.join(places, ["k1", "k2"]).mapInArrow(released(contexts), kinds), "contexts_z")

    def late(batches):
        """Kind 1 of contexts that came together first."""
        task, runs, held = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            for gram, c1, c2, s, r, left, n in zip(*(batch.column(c).to_pylist() for c in ("gram", "c1", "c2", "blob", "r", "left", "n")), strict=True):
                runs.setdefault(gram % n_parts, {})[s, r] = [left, n, c1, c2]
                held += len(s)
            if held > 24 << 20:
                yield from runs_out(runs, task)
                runs, held = {}, 0
        yield from runs_out(runs, task)

    def shares(batches):
        """Hashes of the bytes that the ranges of a context share, and of its passages."""
        for batch in batches:
            told: list[list] = [[], [], [], [], []]
            for c1, c2, s, r, left in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "blob", "r", "left")), strict=True):
                line = s[r:][::-1] + s[:r]
                keys = shared_bytes(line, left, length, cuts)
                if words:
                    keys += [(x << 16 | y, line[left - x : left + y]) for x, y in passages(line, left, length, words, r)]
                for code, body in keys:
                    for v, x in zip(told, (*_digest(body, code & 0xFFFFFFFF), c1, c2, code), strict=True):  # a string counts once for each of its anchors
                        v.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in told[:4]), pa.array(told[4], pa.int32())], ["s1", "s2", "c1", "c2", "code"])

    def split(batches):
        """Kind 1: runs of the trimmed contexts of those ranges whose shared bytes occur twice; kind 4: the contexts that each came from."""
        task = TaskContext.get().partitionId()
        runs: dict[int, dict] = {}
        held = 0
        for batch in batches:
            came: list[list] = [[], [], [], []]
            for c1, c2, s, r, left, n, own in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "blob", "r", "left", "n", "own")), strict=True):
                line, items = s[r:][::-1] + s[:r], []
                for x in own:
                    code = x["code"]
                    if code >= 0:  # a passage
                        d, m = code >> 16, code & 0xFFFF
                        items.append((x["s1"], trimmed(line, left, d + m, d, d)))
                    elif not x["crowded"]:
                        whole = trimmed(line, left, length, *cuts[-1 - code])
                        if whole[1] + whole[2] >= length:  # it holds a string
                            items.append((x["s1"], whole))
                    else:  # each string by itself
                        lo, hi = cuts[-1 - code]
                        alone = [trimmed(line, left, length, d, d) for d in range(max(lo, length - r), min(hi, left) + 1)]
                        items.extend((_digest(*y[:2])[0], y) for y in alone)
                for key, (body, right, before) in items:
                    part = key % n_parts
                    seen = runs.setdefault(part, {}).get((body, right))
                    if seen:
                        seen[1] += n
                    else:
                        seen = runs[part][body, right] = [before, n, *_digest(body, right)]
                        held += len(body)
                    for v, y in zip(came, (seen[2], seen[3], c1, c2), strict=True):
                        v.append(y)
            none = [0] * len(came[0])
            yield rows(4, none, *came, none, [None] * len(none), none)
            if held > 24 << 20:
                yield from runs_out(runs, task)
                runs, held = {}, 0
        yield from runs_out(runs, task)

    def solve(items, alone):
        """(c1, c2, bits) of a stretch of distinct contexts in order; ``alone``: those too short for a string are passages, repeated if they came twice."""
        if not alone:
            return repeated_levels(items, length, reach, words)
        out, whole, share = [], [], length + reach
        for x in items:
            share = min(share, x[0])
            if x[2] + x[3] >= length:
                x[0], share = share, length + reach
                whole.append(x)
            elif x[4] > 1:
                out.append((x[5], x[6], packed_spans(np.zeros(reach + 1, bool), [x[3], x[2]])))
        return out + (repeated_levels(whole, length, reach) if whole else [])

    def merge(batches, alone):
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                blobs.setdefault(part, []).append(blob)
        for part in list(blobs):
            out, items = [], []
            for x in merged(blobs.pop(part)):
                if items and x[0] == len(x[1]) == len(items[-1][1]) and x[2] == items[-1][2]:
                    items[-1][4] += x[4]
                    continue
                if len(items) >= 20_000 and x[0] < GRAM:  # no string begins alike on both sides
                    out.extend(solve(items, alone))
                    items = []
                items.append(list(x))
            out.extend(solve(items, alone) if items else [])
            for at in range(0, len(out), 10_000):
                c1, c2, bits = zip(*out[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bits, pa.binary())], ["c1", "c2", "bits"])

    def merge_whole(batches):
        return merge(batches, False)

    def merge_split(batches):
        return merge(batches, True)

    def solved_runs(runs, how):
        return runs.repartition(int(n_parts), "part").mapInArrow(released(how), "c1 long, c2 long, bits binary")

    runs, dealt, crowd, wide, shared = mixed.where("kind = 1").select("part", "blob"), None, None, None, None
    if twice.where(F.col("n") > hot).limit(1).count():
        # alike contexts of all tasks are one, and most grams have few then
        crowd = mixed.where("kind = 3").groupBy("c1", "c2").agg(F.first("part").alias("gram"), F.first("blob").alias("blob"), F.first("pos").alias("r"), F.first("k1").alias("left"), F.sum("n").alias("n"))
        crowd = written(crowd, "crowd_z")
        wide = written(crowd.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("gram"), "wide")
        runs = runs.unionByName(crowd.join(wide, "gram", "left_anti").mapInArrow(released(late), kinds).select("part", "blob"))
        if wide.limit(1).count():
            many = crowd.join(wide, "gram", "left_semi")
            shared = written(many.mapInArrow(released(shares), "s1 long, s2 long, c1 long, c2 long, code int"), "shared")
            again = shared.groupBy("s1", "s2").agg(F.count("*").alias("m"))
            again = again.where("m > 1").select("s1", "s2", (F.col("m") > hot).alias("crowded"))
            alike = many.where("n > 1").select("c1", "c2")  # these repeat each other
            own = shared.join(alike, ["c1", "c2"], "left_semi").select("s1", "s2", "c1", "c2", "code", F.lit(False).alias("crowded"))
            asked = shared.join(again, ["s1", "s2"]).select("s1", "s2", "c1", "c2", "code", "crowded").unionByName(own)
            asked = asked.groupBy("c1", "c2", "code", "s1").agg(F.max("crowded").alias("crowded")).groupBy("c1", "c2").agg(F.collect_list(F.struct("code", "s1", "crowded")).alias("own"))
            dealt = written(many.join(asked, ["c1", "c2"]).mapInArrow(released(split), kinds), "split_z")
    solved = solved_runs(runs, merge_whole)
    if dealt is not None:
        back = dealt.where("kind = 4").select("c1", "c2", "k1", "k2").join(solved_runs(dealt.where("kind = 1").select("part", "blob"), merge_split), ["c1", "c2"])
        back = back.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.collect_set("bits").alias("bits"))  # one row for a context
        solved = solved.select("c1", "c2", F.array("bits").alias("bits")).unionByName(back)
    else:
        solved = solved.select("c1", "c2", F.array("bits").alias("bits"))
    solved = written(solved, "repeats")

    def around(told: list[bytes]) -> list[tuple[int, int, bool]]:
        """(start, end, short) of the repeated strings of a context, from its anchor."""
        cut, out = reach // 8 + 1, []
        hit = np.frombuffer(told[0][:cut], np.uint8)
        for body in told[1:]:
            hit = hit | np.frombuffer(body[:cut], np.uint8)
        d = np.flatnonzero(np.unpackbits(hit, bitorder="little"))
        more = np.frombuffer(b"".join(body[cut:] for body in told), "<u2").tolist()
        for x, y in sorted((-x, y) for x, y in zip(more[::2], more[1::2], strict=True)):
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], y), True)
            else:
                out.append((x, y, True))
        edge = np.flatnonzero(np.diff(d) > 1)
        if len(d):
            out += [(-y, length - x, False) for x, y in zip(d[np.concatenate(([0], edge + 1))].tolist(), d[np.concatenate((edge, [len(d) - 1]))].tolist(), strict=True)]
        return out

    def intervals(batches):
        known: dict[tuple, list] = {}  # few patterns of hits make up most
        for b in batches:
            row, start, end, short = [], [], [], []
            for i, (pos, told) in enumerate(zip(b.column("pos").to_pylist(), b.column("bits").to_pylist(), strict=True)):
                key = tuple(told)
                found = known.get(key)
                if found is None:
                    if len(known) > 50_000:
                        known.clear()
                    found = known[key] = around(told)
                for x, y, z in found:
                    row.append(i), start.append(pos + x), end.append(pos + y), short.append(z)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k1").take(take), b.column("k2").take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(short, pa.bool_())], ["k1", "k2", "start", "end", "short"])

    where = mixed.where("kind = 0").select("c1", "c2", "k1", "k2", "pos").join(solved, ["c1", "c2"]).select("k1", "k2", "pos", "bits").mapInArrow(released(intervals), "k1 long, k2 long, start int, end int, short boolean")
    out = written(where.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end", "short")).alias("spans")), "spans")
    discard(found, twice, mixed, crowd, wide, shared, dealt, solved)
    return out


def _joined(spans_: list[tuple[int, int]]) -> list[dict]:
    """Maximal runs of spans."""
    runs: list[dict] = []
    for x, y in sorted(spans_):
        if runs and x <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], y)
        else:
            runs.append({"start": x, "end": y})
    return runs


def remove(docs: DataFrame, length: int = 400, hot: int = 40_000, as_text: bool = False, words: int = 0) -> DataFrame:
    """Documents with ``kept`` (remaining bytes, or with ``as_text`` the text of those characters that remain whole), n_bytes, n_removed and ``removed``, the maximal runs taken out as (start, end).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else
    in the input, or with ``words`` a passage of so many whole words, however short
    in bytes. Null texts are empty; texts shorter than ``length`` lose nothing
    but passages; rows alike are copies of each other; no documents give none. Columns of
    the input whose names clash with those added are replaced.
    """
    ship(docs.sparkSession)
    base = docs.drop("kept", "n_bytes", "n_removed", "removed", "k1", "k2", "spans")
    found = spans(docs.select("doc_id", "text"), length, hot=hot, words=words)
    keyed = base.withColumn("k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("k2", F.xxhash64("text"))
    rows = keyed.join(found, ["k1", "k2"], "left")
    names = [c for c in base.columns if c != "text"]

    def cut(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            kept, removed, size = [], [], []
            for text, own in zip(b.column("text").cast(pa.large_binary()), b.column("spans").to_pylist(), strict=True):
                text = text.as_py() or b""
                runs = _joined([(s["start"], s["end"]) for s in own or ()])
                edges = [0, *(v for r in runs for v in (r["start"], r["end"])), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(runs), size.append(len(text))
            gone = [s - len(k) for s, k in zip(size, kept, strict=True)]
            if as_text:
                kept = [k.decode("utf-8", "ignore") for k in kept]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, kind)], [*names, "kept", "n_bytes", "n_removed", "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    return rows.select(*names, "text", "spans").mapInArrow(released(cut), f"{schema}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>")
