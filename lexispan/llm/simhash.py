"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it. Fingerprints are cut into m segments; two within ``distance`` bits agree in
some segment up to distance // m bits, so the small Hamming ball around each
segment value, looked up in a table of that segment, misses no link. Whole
distances decide, and each bucket gives links that join what it holds, not all
its pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import components, discard, parts, released, ship, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles in their order; all words are one where there are fewer. Only A to Z are lower-cased; words end at space and U+0009 to U+000D."""
    from xxhash import xxh64_intdigest

    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends]]
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :])], np.uint64)  # noqa: B905  starts is the longer


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64 bits; no word: 0."""
    return majority(shingles(text, words, seed))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    n = len(h)
    if n < 2:
        return int(h[0]) if n else 0
    bits = np.zeros((-(-n // 255) * 255, 64), np.uint8)
    bits[:n] = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    count = bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a long of the same bits; null text is empty."""
    ship(docs.sparkSession)

    def each(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(each), "doc_id long, fp long")


def layout(n: int, distance: int, row: float = 50.0) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of the segments that cost n fingerprints least, a row looked up being worth ``row`` comparisons.

    Fewer, longer segments have larger balls; more, shorter ones have fuller
    buckets. Each number of segments misses no link.
    """

    def edges(m: int) -> list[int]:
        return [64 * i // m for i in range(m + 1)]

    def cost(m: int) -> float:
        total = 0.0
        for a, b in zip(edges(m)[:-1], edges(m)[1:], strict=True):
            ball = sum(comb(b - a, r) for r in range(distance // m + 1))
            total += ball * (row + n / 2 ** (b - a))
        return total

    m = min(range(2, max(2, distance) + 1), key=cost)
    return [(a, b - a, distance // m) for a, b in zip(edges(m)[:-1], edges(m)[1:], strict=True)]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def group_links(fp: np.ndarray, distance: int, split: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that join all that are joined by links: each is reached once."""
    if len(fp) > split:
        return split_links(fp, distance, split)
    left, a, b = fp.copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _bits(left ^ x) <= distance
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x, np.uint64))
                b.append(hit)
                queue.extend(hit)
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def split_links(fp: np.ndarray, distance: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """As group_links, by the buckets of each two of distance + 2 segments: two fingerprints within ``distance`` agree in two of them.

    Segments are of those bits in which the fingerprints differ; a bucket that is
    still crowded is split by those in which its own do.
    """
    same = ~(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp))
    bits = [p for p in range(64) if not int(same) >> p & 1]
    cuts = [bits[len(bits) * i // (distance + 2) : len(bits) * (i + 1) // (distance + 2)] for i in range(distance + 2)]
    fp = np.sort(fp)
    root = np.arange(len(fp))
    none = np.zeros(0, np.uint64)
    a, b = [none], [none]
    for x, y in combinations(cuts, 2):
        key = fp & np.uint64(sum(1 << p for p in x + y))
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order])) + 1
        for own in np.split(order, edge):
            if len(own) < 2 or (root[own] == root[own[0]]).all():
                continue
            p, q = group_links(fp[own], distance, split if len(own) < len(fp) else len(fp))
            if len(p):
                i, j = np.searchsorted(fp, p), np.searchsorted(fp, q)
                for k, (u, v) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    while root[u] != u:
                        root[u] = u = root[root[u]]
                    while root[v] != v:
                        root[v] = v = root[root[v]]
                    if u != v:
                        root[max(u, v)] = min(u, v)
                        a.append(p[k : k + 1]), b.append(q[k : k + 1])
        while (root != root[root]).any():
            root = root[root]
    return np.concatenate(a), np.concatenate(b)


def bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, sorted by key. Buckets of few pairs give all that hold, larger ones a joining part."""
    edge = np.flatnonzero(np.diff(key)) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
    table = np.add.reduceat((~probe).astype(np.int64), first)
    n = last - first
    use = np.flatnonzero((table > 0) & (n > 1))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = use[n[use] ** 2 <= most]
    if len(small):
        reps = n[small] ** 2
        of = np.repeat(small, reps)
        k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        i, j = first[of] + k // n[of], first[of] + k % n[of]
        x, y = fp[i], fp[j]
        ok = (x < y) & ~(probe[i] & probe[j]) & (_bits(x ^ y) <= distance)
        a.append(x[ok]), b.append(y[ok])
    for g in use[n[use] ** 2 > most]:
        own, asks = fp[first[g] : last[g]], probe[first[g] : last[g]]
        held = own[~asks]
        if len(held) * len(own) <= 1 << 22:
            i, j = np.nonzero(_bits(held[:, None] ^ own[None, :]) <= distance)
            x, y = held[i], own[j]
            i = np.flatnonzero(x != y)
            if len(i) <= 4 * len(own):
                a.append(np.minimum(x[i], y[i])), b.append(np.maximum(x[i], y[i]))
                continue
        x, y = group_links(np.unique(own), distance)
        a.append(x), b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(values: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that join all fingerprints joined by distances of at most ``distance``."""
    spark = values.sparkSession
    ship(spark)
    segments = layout(values.count(), distance)
    masks = [np.array([sum(1 << p for p in places) << shift for r in range(1, radius + 1) for places in combinations(range(bits), r)], np.uint64) for shift, bits, radius in segments]
    size = 1 + sum(map(len, masks)) // len(masks)

    def probes(batches):
        for batch in batches:
            all_fp = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(all_fp), max(1, 300_000 // size)):
                fp = all_fp[at : at + max(1, 300_000 // size)]
                for number, ((shift, bits, _), mask) in enumerate(zip(segments, masks, strict=True)):
                    balls = np.concatenate((fp[:, None], fp[:, None] ^ mask[None, :]), axis=1)
                    key = ((balls >> np.uint64(shift)) & np.uint64((1 << bits) - 1)) | np.uint64(number << 60)
                    probe = np.ones(balls.shape, bool)
                    probe[:, 0] = False
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, 1 + len(mask)).view(np.int64)), pa.array(probe.ravel())], ["key", "fp", "probe"])

    def find(batches):
        """Buckets come one after another; what is read of one is put together once."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            new = [batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("probe").to_numpy(zero_copy_only=False)]
            if not len(new[0]):
                continue
            end = np.searchsorted(new[0], new[0][-1])
            if end or (held and held[-1][0][-1] != new[0][0]):
                held.append([x[:end] for x in new])
                yield from out(*bucket_links(*(np.concatenate(x) for x in zip(*held, strict=True)), distance))
                held = []
            held.append([x[end:] for x in new])
        if held:
            yield from out(*bucket_links(*(np.concatenate(x) for x in zip(*held, strict=True)), distance))

    def out(a, b):
        if len(a):
            pair = np.unique(np.stack((a, b)), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], ["a", "b"])

    dealt = values.select("fp").repartition(parts(spark)).mapInArrow(released(probes), "key long, fp long, probe boolean")
    return dealt.repartition(parts(spark), "key").sortWithinPartitions("key").mapInArrow(released(find), "a long, b long")


def classes(docs: DataFrame, words: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """(doc_id, fp, class_fp, component_id) of each row.

    component_id is the smallest doc_id that its fingerprint reaches. Null and
    empty texts have fingerprint 0 and link like others; rows alike are one class;
    rows without an id get the smallest id of their class, null if it has none.
    Columns other than doc_id and text are not read.
    """
    found = written(fingerprints(docs, words, seed), "fingerprints")
    reps = written(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "values")
    joined = components(links(reps, distance), "classes")
    grouped = reps.join(joined, reps.fp == joined.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("class_fp"))
    lowest = grouped.groupBy("class_fp").agg(F.min("low").alias("component_id"))
    named = written(grouped.join(lowest, "class_fp").select("fp", "class_fp", "component_id"), "named")
    return found.join(named, "fp").select("doc_id", "fp", "class_fp", "component_id")


def kept(docs: DataFrame, words: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One document of each class, that of the smallest id; of rows that share this id, or have none, one stays."""
    named = classes(docs, words, seed, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = written(named.select("doc_id", "class_fp"), "stays")
    once = stays.groupBy("doc_id").agg(F.min("class_fp").alias("_class"))
    joined = docs.join(once.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        # ids that repeat, or none: fingerprints again tell the rows' classes, and one row of each stays
        ship(docs.sparkSession)
        udf = F.pandas_udf(lambda s: s.map(lambda t: np.uint64(fingerprint((t or "").encode(), words, seed)).astype(np.int64)), "long")
        first = classes(docs, words, seed, distance).select("fp", "class_fp", "component_id").distinct()
        rows = docs.withColumn("_fp", udf(F.coalesce("text", F.lit("")))).join(first.withColumnRenamed("fp", "_fp"), "_fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        return rows.dropDuplicates(["class_fp"]).select(docs.columns)
    return joined.select(docs.columns)


#: 24 bands of 5 minima: of pairs with a Jaccard similarity of 0.8, 7 in 100,000 agree in none.
BANDS, ROWS = 24, 5
_XOR, _TIMES = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_TIMES = _TIMES << np.uint64(1) | np.uint64(1)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima of the set ``own``; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 2048):
        x = (own[None, at : at + 2048] ^ _XOR) * _TIMES
        np.minimum(low, ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).min(axis=1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(t, node, fp, bands) of texts (t, text): the hash of the shingles' set, its fingerprint and its band keys."""
    from xxhash import xxh64_intdigest

    ship(docs.sparkSession)

    def each(batches):
        for b in batches:
            own = [np.unique(shingles(t.as_py() or b"", words, seed)) for t in b.column("text").cast(pa.large_binary())]
            node = np.fromiter((xxh64_intdigest(x.tobytes(), seed) for x in own), np.uint64, len(own))
            fp = np.fromiter(map(majority, own), np.uint64, len(own))
            yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(list(map(bands, own)), pa.list_(pa.int64()))], ["t", "node", "fp", "bands"])

    return docs.select("t", "text").mapInArrow(released(each), "t long, node long, fp long, bands array<long>")


def nearest_pairs(node: np.ndarray, fp: np.ndarray, group: np.ndarray, bits: int = 22) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a bucket with the nearest fingerprint of another group, if within ``bits``."""
    a, b = [], []
    step = max(1, (1 << 21) // len(node))
    for at in range(0, len(node), step):
        far = _bits(fp[at : at + step, None] ^ fp[None, :]).astype(np.int16)
        far[group[at : at + step, None] == group[None, :]] = 99
        j = far.argmin(axis=1)
        i = np.flatnonzero(far[np.arange(len(far)), j] <= bits)
        a.append(np.minimum(node[at + i], node[j[i]])), b.append(np.maximum(node[at + i], node[j[i]]))
    pair = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
    return pair[0], pair[1]


def exact_pairs(node: np.ndarray, own: list[np.ndarray], group: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Links between groups of a bucket whose sets ``own`` have a Jaccard similarity of ``least``: all pairs decide, one link joins two groups."""
    n = np.array(list(map(len, own)))
    starts = np.cumsum(n) - n
    place = np.unique(np.concatenate(own), return_inverse=True)[1]
    held = np.zeros(place.max() + 1, np.int64)
    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    a, b = [], []
    for i in np.flatnonzero(group != size.argmax()):  # those of the largest group meet each other one here
        mine = place[starts[i] : starts[i] + n[i]]
        held[mine] = 1
        both = np.add.reduceat(held[place], starts)
        held[mine] = 0
        for g in np.unique(group[(both >= least * (n + n[i] - both)) & (group != group[i])]):
            j = np.flatnonzero((both >= least * (n + n[i] - both)) & (group == g))[0]
            a.append(min(node[i], node[j])), b.append(max(node[i], node[j]))
            group[group == g] = group[i]
    return a, b


def proposals(nodes: DataFrame, joined: DataFrame | None, texts: DataFrame, words: int, seed: int, least: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) of nodes that share a band's key and are not joined yet: the nearest of each node, or all that joins, confirmed."""
    spark = nodes.sparkSession
    rows = nodes.select("node", "fp", "bands")
    rows = rows.withColumn("group", F.col("node")) if joined is None else rows.join(joined, "node", "left").select("node", "fp", "bands", F.coalesce("component", "node").alias("group"))
    rows = rows.select(F.explode("bands").alias("key"), "node", "fp", "group")
    mixed = rows.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("key")
    rows = rows.join(mixed, "key")
    if not nearest:
        rows = written(rows, "mixed")
        rows = rows.join(sets(rows.select("node").distinct(), nodes, texts, words, seed), "node").select("key", "node", "fp", "group", "own")

    def find(batches):
        held: list = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            own = batch.column("own").to_pylist() if not nearest else [b""] * len(key)
            for row in zip(key.tolist(), batch.column("node").to_pylist(), batch.column("fp").to_pylist(), batch.column("group").to_pylist(), own, strict=True):
                if held and held[-1][0] != row[0]:
                    yield from out(held)
                    held = []
                held.append(row)
        yield from out(held)

    def out(held):
        if len(held) > 1:
            _, node, fp, group, own = zip(*held, strict=True)
            node, group = np.array(node), np.array(group)
            if nearest:
                a, b = nearest_pairs(node, np.array(fp).view(np.uint64), group)
            else:
                a, b = exact_pairs(node, [np.frombuffer(x, np.uint64) for x in own], group, least)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(parts(spark), "key").sortWithinPartitions("key").mapInArrow(released(find), "a long, b long").distinct()


def sets(used: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, seed: int) -> DataFrame:
    """(node, own) with the sorted hashes of the shingles of those nodes that are ``used``."""

    def each(batches):
        for b in batches:
            own = [np.unique(shingles(t.as_py() or b"", words, seed)).tobytes() for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(own, pa.binary())], ["node", "own"])

    of = used.join(nodes.select("node", F.col("t").alias("_t"), "low"), "node")
    one = texts.join(of, (F.col("t") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("low")))  # by both, as one text may have many rows
    return written(one.dropDuplicates(["node"]).select("node", "text").mapInArrow(released(each), "node long, own binary"), "sets")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, seed: int, least: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of ``least``."""

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                few, many = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if few >= least * many else 0
                ok.append(both >= least * (few + many - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts, words, seed)
    left = pairs.join(held.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    out = written(left.join(held.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(released(check), "a long, b long"), "confirmed")
    discard(held)
    return out


def similar_kept(docs: DataFrame, words: int = 5, seed: int = 42, distance: int = 8, least: float = 0.8) -> DataFrame:
    """One row, of the smallest id, of each group of texts joined by pairs that share ``least`` of all their shingles (Jaccard, as sets).

    Fingerprints within ``distance`` bits propose first, which joins most of a
    large group by few links. Then texts that agree in a band of minima propose what
    is not joined yet: each its nearest, and at last all, whose sets meet in the
    band's bucket. Every link is confirmed on the sets of hashed shingles.
    """
    keyed = docs.withColumn("_t", F.xxhash64("text"))
    ids = written(keyed.groupBy(F.col("_t").alias("t"), "doc_id").agg(F.count("*").alias("n")), "ids")
    texts = keyed.select(F.col("_t").alias("t"), "doc_id", "text")
    found = written(sketches(texts, words, seed), "sketches").dropDuplicates(["t"])
    low = ids.groupBy("t").agg(F.min("doc_id").alias("low"))
    nodes = written(found.groupBy("node").agg(F.min("t").alias("t"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).join(low, "t"), "nodes")
    same = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = links(same, distance).distinct()  # a pair may meet in several segments
    first = near.join(same.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(same.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    alike = nodes.join(same.withColumnRenamed("node", "x"), "fp").select("x", F.col("node").alias("y")).where("x <> y")
    pairs, joined = first.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), None
    for nearest in (True, False, None):
        pairs = written(pairs, "pairs")
        if pairs.limit(1).count():
            new = pairs if nearest is None else confirmed(pairs, nodes, texts, words, seed, least)
            # what is joined already goes on as one link a node, however many links joined it
            edges = new if joined is None else new.unionByName(joined.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
            joined = written(components(edges, "joined"), "classes")
        if nearest is not None:
            pairs = proposals(nodes, joined, texts, words, seed, least, nearest)
    rows = ids.join(found.select("t", "node"), "t")
    if joined is not None:
        rows = rows.join(joined, "node", "left").withColumn("node", F.coalesce("component", "node"))
    # the smallest id; of rows that share it, or have none, that of the smallest hash
    stays = written(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "n")).alias("s")).select("s.*"), "stays")
    out = keyed.join(stays.select(F.col("doc_id").alias("_id"), "t"), (F.col("_t") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    if stays.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["_id", "_t"])
    return out.select(docs.columns)
