"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Each shard's graph is one row of flat arrays: neighbours of the lowest level, a
row of slots per vector, and those of the upper levels. Query blocks go to each
shard, whose graph is moved and read once, and the shards' nearest are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import parts, released, ship, written
from lexispan.llm.vector_dedup import matrices, sound


class Graph:
    """Vectors (n, dim) and, per level, slots of neighbours; -1: empty."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.levels, self.links, self.entry = x, levels, links, entry

    def _distances(self, q: np.ndarray, at) -> np.ndarray:
        d = self.x[at] - q
        return np.einsum("ij,ij->i", d, d)

    def search(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The nearest found, at most ``ef``, ascending."""
        links, seen = self.links[level], np.zeros(len(self.x), bool)
        seen[[i for _, i in entries]] = True
        ahead, best = list(entries), [(-d, i) for d, i in entries]
        heapq.heapify(ahead), heapq.heapify(best)
        while ahead:
            d, i = heapq.heappop(ahead)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            dist = self._distances(q, near)
            if len(best) >= ef:
                ok = dist < -best[0][0]
                near, dist = near[ok], dist[ok]
            for d2, j in zip(dist.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-d2, j))
                elif d2 < -best[0][0]:
                    heapq.heapreplace(best, (-d2, j))
                else:
                    continue
                heapq.heappush(ahead, (d2, j))
        return sorted((-d, i) for d, i in best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        """The entry for level ``to``, one nearest at a time from the top."""
        at = [(float(self._distances(q, [self.entry])[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), to, -1):
            at = self.search(q, at[:1], 1, level)
        return at

    def nearest(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        return self.search(q, self.descend(q, 0), ef, 0)


def diverse(x: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Of vectors by ascending distance those nearer to the new one than to any chosen; then the nearest passed over, up to ``most``."""
    if len(found) <= most:
        return [i for _, i in found]
    at, d = np.array([i for _, i in found]), np.array([d for d, _ in found])
    v = x[at]
    norm = np.einsum("ij,ij->i", v, v)
    between = norm[:, None] + norm[None, :] - 2 * (v @ v.T)
    chosen, nearest = [], np.full(len(at), np.inf)
    for k in range(len(at)):
        if d[k] < nearest[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            np.minimum(nearest, between[k], out=nearest)
    passed = [k for k in range(len(at)) if k not in set(chosen)]
    return at[(chosen + passed)[:most]].tolist()


def build(x: np.ndarray, ids: np.ndarray, m: int = 16, ef: int = 80, seed: int = 5) -> Graph:
    """Insert vector after vector; levels come from the ids' hashes, so reruns agree."""
    u = (((ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    levels = np.minimum((-np.log(np.maximum(u, 1e-18)) / np.log(m)).astype(np.int64), 8)
    links = [np.full((len(x), 2 * m if v == 0 else m), -1, np.int32) for v in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(x, levels, links, 0)
    for i in range(1, len(x)):
        top, own = int(levels[graph.entry]), int(levels[i])
        at = graph.descend(x[i], min(own, top)) if own < top else [(float(graph._distances(x[i], [graph.entry])[0]), graph.entry)]
        for level in range(min(own, top), -1, -1):
            at = graph.search(x[i], at, ef, level)
            slots = links[level]
            near = diverse(x, at, m)
            slots[i, : len(near)] = near
            for j in near:
                row = slots[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    both = np.append(row, i)
                    d = graph._distances(x[j], both)
                    order = np.argsort(d, kind="stable")
                    keep = diverse(x, list(zip(d[order].tolist(), both[order].tolist(), strict=True)), len(row))
                    row[:] = -1
                    row[: len(keep)] = keep
        if own > top:
            graph.entry = i
    return graph


def index(vectors: DataFrame, shard_rows: int = 4096, m: int = 16, ef: int = 80, seed: int = 5) -> tuple[DataFrame, int]:
    """A written table of shards (shard, dim, ids, starts, vectors, levels, entry, links) and their number.

    Every sound row is in it. Equal vectors of a shard are one node with several
    ids, ascending; vectors of other dimensions are graphs of their own.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound() & F.col("vec_id").isNotNull())
    n = max(1, -(-rows.count() // shard_rows))
    names = ["shard", "dim", "ids", "starts", "vectors", "levels", "entry", "links"]

    def graph(s, batches):
        own = pa.Table.from_batches(batches).combine_chunks()
        for at, x in matrices(own.column("embedding")):
            ids = own.column("vec_id").to_numpy()[at]
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            _, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
            rank = np.argsort(first)  # nodes by their smallest id
            of = np.argsort(rank)[of.ravel()]
            by = np.argsort(of, kind="stable")
            starts = np.concatenate(([0], np.cumsum(np.bincount(of))))
            node = x[first[rank]]
            g = build(node, ids[first[rank]], m, ef, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int64()), pa.array([x.shape[1]], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids[by], starts.astype(np.int64), node.astype(np.float64), g.levels.astype(np.int8))), pa.array([g.entry], pa.int32()), pa.array([[v.tobytes() for v in g.links]], pa.list_(pa.binary()))], names
            )

    def graphs(batches):
        """Shards come one after another, and one is held at a time."""
        now, held = None, []
        for b in batches:
            shard = b.column("shard").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if x == y:
                    continue
                if held and int(shard[x]) != now:
                    yield from graph(now, held)
                    held = []
                now = int(shard[x])
                held.append(b.slice(x, y - x))
        if held:
            yield from graph(now, held)

    # a partition for each shard: by its hash, several could fall into one
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")).repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard")
    return written(dealt.mapInArrow(released(graphs), "shard long, dim int, ids binary, starts binary, vectors binary, levels binary, entry int, links array<binary>"), "graphs"), n


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, ef: int = 160, block: int = 256, shard_rows: int = 4096, m: int = 16, ef_build: int = 80) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by Euclidean distance, ties to the smaller id.

    A query's own id is no candidate. Vectors that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows without an id; with
    fewer candidates all come. Rows that share an id are candidates each for itself.
    """
    spark = vectors.sparkSession
    graphs, n = index(vectors, shard_rows, m, ef_build)
    ask = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound() & F.col("vec_id").isNotNull())

    def blocks(batches):
        for b in batches:
            for at, x in matrices(b.column("embedding")):
                ids = b.column("vec_id").to_numpy()[at]
                for p in range(0, len(ids), block):
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([ids[p : p + block].tobytes()], pa.binary()), pa.array([x[p : p + block].tobytes()], pa.binary())], ["dim", "q_ids", "q_vectors"])

    few = max(1, ask.count() // block)
    asked = ask.repartition(few).mapInArrow(released(blocks), "dim int, q_ids binary, q_vectors binary")
    # a graph, then the blocks that it answers; each query asks each shard, as any may hold a nearest one
    asked = asked.join(graphs.groupBy("dim").agg(F.collect_list("shard").alias("shards")), "dim").select(F.explode("shards").alias("shard"), "dim", "q_ids", "q_vectors")
    empty = [F.lit(None).cast(graphs.schema[c].dataType).alias(c) for c in ("ids", "starts", "vectors", "levels", "entry", "links")]
    both = graphs.withColumns({"q_ids": F.lit(None).cast("binary"), "q_vectors": F.lit(None).cast("binary")}).withColumn("kind", F.lit(0))
    both = both.unionByName(asked.select("shard", "dim", *empty, "q_ids", "q_vectors").withColumn("kind", F.lit(1)))

    def answers(batches):
        ids = starts = g = None
        for b in batches:
            for row in b.to_pylist():
                if not row["kind"]:
                    x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                    ids, starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
                    g = Graph(x, np.frombuffer(row["levels"], np.int8), [np.frombuffer(v, np.int32).reshape(len(x), -1) for v in row["links"]], row["entry"])
                    continue
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"]).reshape(-1, row["dim"])
                out = [[], [], []]
                for own, v in zip(q_ids.tolist(), q, strict=True):
                    got = []
                    for d, i in g.nearest(v, ef):
                        if len(got) >= k and d > got[-1][0]:
                            break
                        got.extend((d, j) for j in ids[starts[i] : min(starts[i + 1], starts[i] + k + 1)].tolist() if j != own)
                    for d, j in sorted(got)[:k]:
                        out[0].append(own), out[1].append(j), out[2].append(float(np.sqrt(d)))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    met = both.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "dim", "kind").mapInArrow(released(answers), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
