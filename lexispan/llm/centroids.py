"""Clustering around centroids by sort-means, in whole numbers.

Each round sorts, for every centroid, the others by their distance from it. A vector
begins at the centroid of its last round and goes through the others in that order;
once one lies strictly more than twice as far from that centroid as the vector does,
the triangle inequality leaves none that could be as near, and the search ends. All
distances are squared whole numbers, so ties are ties and results do not depend on
how vectors are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import discard, released, ship, written

#: Components within this bound have squared distances that 64 bits hold; beyond it numbers of any length are used.
_SMALL = 1 << 26
#: Distances and sums that a long cannot hold are given as the greatest long.
_MOST = (1 << 63) - 1
#: Components beyond this are taken as this: their distances from others are past a long anyway.
_BOUND = float(1 << 54)


def scaled(rows: DataFrame, components: int, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the vectors with exactly so many components, none null or not finite: v holds floor(scale * component)."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    inside = lambda c: F.greatest(F.least(c, F.lit(_BOUND)), F.lit(-_BOUND))
    return x.where((F.size("e") == components) & finite).select("vec_id", F.transform("e", lambda c: F.floor(F.lit(float(scale)) * inside(c))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of smallest sha256 of `seed:vec_id`, in its order; of equal ids the smaller vector first, null ids last."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in vectors.orderBy(by.asc_nulls_last(), "v").select("v").limit(k).collect()]


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all of them by distance from it, itself first, and the squared distances in that order."""
    apart = np.array([((centroids - c) ** 2).sum(1) for c in centroids])
    order = np.array([sorted(range(len(centroids)), key=lambda j: (j != i, apart[i][j], j)) for i in range(len(centroids))])
    return order, np.take_along_axis(apart, order, 1)


def nearest(v: np.ndarray, last: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector, by sort-means from its ``last`` one; of equally near ones the smaller number."""
    best = last.copy()
    away = ((v - centroids[last]) ** 2).sum(1)
    from_last = away.copy()
    for c in np.unique(last):
        own = np.flatnonzero(last == c)
        for j, d in zip(order[c, 1:].tolist(), apart[c, 1:].tolist(), strict=True):
            own = own[from_last[own] >= -(-d // 4)]  # d > 4 x: strictly beyond twice as far
            if not len(own):
                break
            x = ((v[own] - centroids[j]) ** 2).sum(1)
            better = (x < away[own]) | ((x == away[own]) & (j < best[own]))
            at = own[better]
            away[at], best[at] = x[better], j
    return best, away


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, components)


def _small(*arrays: np.ndarray) -> bool:
    return all(not a.size or (int(a.max()) <= _SMALL and int(a.min()) >= -_SMALL) for a in arrays)


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, v, cluster, distance) of vectors with their ``last`` cluster."""
    ship(vectors.sparkSession)
    exact = np.array(centroids, object)

    def put(batches):
        components = exact.shape[1]
        plain = _small(exact)
        c = exact.astype(np.int64) if plain else exact
        order, apart = orders(c)
        for b in batches:
            v, last = _matrix(b.column("v"), components), b.column("last").to_numpy()
            if plain and _small(v):
                best, away = nearest(v, last, c, order, apart)
            else:
                best, away = nearest(v.astype(object), last, exact, *orders(exact))
                away = np.array([min(x, _MOST) for x in away], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(best.astype(np.int32)), pa.array(away)], ["vec_id", "v", "cluster", "distance"])

    return vectors.mapInArrow(released(put), "vec_id long, v array<long>, cluster int, distance long")


def moved(found: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid that has vectors at the floor of their means, the others where they were.

    Tasks add up their vectors per cluster first, so what is shuffled is at most a row per
    task, cluster and place, however many vectors one cluster has; the driver gets the k centroids.
    """
    k, components = len(centroids), len(centroids[0])

    def summed(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, components), object)
        for b in batches:
            v, cluster = _matrix(b.column("v"), components), b.column("cluster").to_numpy()
            v = v if _small(v) else v.astype(object)
            for c in np.unique(cluster):
                own = v[cluster == c]
                n[c] += len(own)
                total[c] += own.sum(0).astype(object)
        own = np.flatnonzero(n)
        columns = [np.repeat(own, components).astype(np.int32), np.tile(np.arange(components, dtype=np.int32), len(own)), np.repeat(n[own], components)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(total[own].ravel().tolist(), pa.decimal128(38, 0))], ["cluster", "place", "n", "total"])

    parts = found.select("cluster", "v").mapInArrow(released(summed), "cluster int, place int, n long, total decimal(38,0)")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.cluster][r.place] = int(r.total) // r.n
    return out


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance) of each vector after so many rounds and a last assignment, and the centroids, as many as there are vectors if these are fewer than k.

    Vectors of another length, or that are null or hold null or non-finite components, take
    no part; repeated rows and rows that share an id, or have none, are vectors each. Other columns are not
    read. Components beyond 2^54 count as 2^54, and distances past a long are given as the greatest long.
    The vectors move only from table to table, each round's being discarded after the next is written.
    """
    vectors = written(scaled(rows, components), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.selectExpr("vec_id", "v", "cast(NULL AS int) AS cluster", "cast(NULL AS long) AS distance"), []
    found = vectors.withColumn("cluster", F.lit(0))
    for turn in range(rounds + 1):
        new = written(assigned(found.select("vec_id", "v", F.col("cluster").alias("last")), centroids), "assigned")
        discard(vectors if not turn else found)
        found = new
        if turn < rounds:
            centroids = moved(found, centroids)
    return found, centroids


def told(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the result of ``cluster``. What is broadcast is one row per centroid."""
    spark = found.sparkSession
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()} if centroids else {}
    total = min(sum(sums.values()), _MOST)
    rows = [(i, min(sums.get(i, 0), _MOST), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
