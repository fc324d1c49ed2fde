"""Near-duplicate vectors by Euclidean p-stable hashing.

A table puts a normalised vector x into the bucket of floor((a.x + b) / width) for
k random normal a. Vectors of cosine c lie at distance sqrt(2 - 2c), for which the
chance to share a bucket is known, so the number of tables follows from the share
of links that may be missed. Cosines in double precision then decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import components, parts, released, ship, written


def collide(distance: float, width: float) -> float:
    """Chance that one projection puts two vectors of this distance together (Datar et al. 2004)."""
    t = width / distance
    below = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def layout(n: int, cosine: float, width: float = 2.0, bucket: int = 256, miss: float = 1e-3) -> tuple[int, int]:
    """(k, tables): unrelated vectors come about ``bucket`` to a bucket, links of the least cosine are missed at ``miss``.

    Comparing a bucket's vectors costs less than moving them to another table, so
    buckets are full and tables few.
    """
    near, far = collide(math.sqrt(2 - 2 * cosine), width), collide(math.sqrt(2), width)
    k = max(2, round(math.log(max(n, bucket) / bucket) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


def projections(dim: int, k: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, width, tables * k)


def keys(x: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket of each unit vector in each table, as a 64-bit mix that also holds the table and the dimension."""
    a, b = projections(x.shape[1], k, tables, width, seed)
    cell = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, k).view(np.uint64)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]), cell.shape[:2]).copy()
    for i in range(k):
        h = (h ^ cell[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def sound(vector: str = "embedding"):
    """Neither null, empty nor zero, and each component a finite number."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))


def matrices(column: pa.Array):
    """(rows, float64 matrix) of the vectors of each dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    values, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, values[first[rows][:, None] + np.arange(dim)].astype(np.float64)


def bucket_pairs(x: np.ndarray, cosine: float, split: np.ndarray | None = None, block: int = 2048):
    """(i, j), i < j, of unit vectors with at least this cosine; only across the two sides of ``split`` if given."""
    for a in range(0, len(x), block):
        for b in range(a, len(x), block):
            i, j = np.nonzero(x[a : a + block] @ x[b : b + block].T >= cosine)
            i, j = i + a, j + b
            ok = i < j
            if split is not None:
                ok &= split[i] != split[j]
            yield i[ok], j[ok]


def lowest_label(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(vectors: DataFrame, cosine: float = 0.9, width: float = 2.0, miss: float = 1e-3, seed: int = 11, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Of distinct sound vectors (vec_id, embedding, copies): (vec_id, n), the rows of other vectors linked to each, and edges (a, b) that join what links join.

    A bucket of over ``hot`` vectors is cut into blocks, each pair of which is a
    bucket of its own. A pair counts in the first table that puts it together.
    """
    spark = vectors.sparkSession
    ship(spark)
    k, tables = layout(vectors.count(), cosine, width, miss=miss)

    def unit(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def numbered(batches):
        for batch in batches:
            for rows, m in matrices(batch.column("embedding")):
                for at in range(0, len(rows), 1000):
                    own, key = pa.array(rows[at : at + 1000]), keys(unit(m[at : at + 1000]), k, tables, width, seed)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(key[:, t]), pa.array(np.full(len(own), t, np.int32)), *(batch.column(c).take(own) for c in ("vec_id", "copies", "embedding"))], ["key", "tab", "vec_id", "copies", "embedding"])

    def found(batches):
        def solve(group):
            out = []
            for rows, m in matrices(group.column("embedding")):
                if len(rows) < 2:
                    continue
                x, ids, copies = unit(m), group.column("vec_id").to_numpy()[rows], group.column("copies").to_numpy()[rows]
                t, side = int(group.column("tab")[0].as_py()), group.column("side").to_numpy()[rows]
                pairs = [np.concatenate(v) for v in zip(*bucket_pairs(x, cosine, side if group.column("across")[0].as_py() else None), strict=True)]
                i, j = pairs
                if not len(i):
                    continue
                seen, of = np.unique(np.concatenate((i, j)), return_inverse=True)
                before = keys(x[seen], k, tables, width, seed)[:, :t]
                label = lowest_label(len(rows), i, j)
                n = np.zeros(len(rows), np.int64)
                for at in range(0, len(i), 100_000):
                    p, q = of[: len(i)][at : at + 100_000], of[len(i) :][at : at + 100_000]
                    first = ~(before[p] == before[q]).any(axis=1)
                    np.add.at(n, i[at : at + 100_000][first], copies[j[at : at + 100_000][first]])
                    np.add.at(n, j[at : at + 100_000][first], copies[i[at : at + 100_000][first]])
                use = np.flatnonzero((n > 0) | (label != np.arange(len(rows))))
                out.append((ids[use], ids[label[use]], n[use]))
            return out

        def emit(out):
            for a, b, n in out:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key, sub = t.column("key").to_numpy(), t.column("sub").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(sub) != 0)) + 1))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1:
                    yield from emit(solve(t.slice(a, b - a).combine_chunks()))
            held = t.slice(edge[-1]).combine_chunks()
        if held is not None and len(held) > 1:
            yield from emit(solve(held))

    kind = vectors.schema["embedding"].dataType.simpleString()
    dealt = vectors.select("vec_id", "copies", "embedding").repartition(parts(spark)).mapInArrow(released(numbered), f"key long, tab int, vec_id long, copies long, embedding {kind}")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot)
    sizes = written(sizes.select("key", F.ceil(F.col("size") / hot).cast("long").alias("blocks")), "hot")
    if sizes.limit(1).count():
        own = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        dealt = dealt.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("side", own).withColumn("other", other)
        dealt = dealt.withColumn("sub", F.least("side", "other") * F.col("blocks") + F.greatest("side", "other")).withColumn("across", F.col("side") != F.col("other")).drop("blocks", "other")
    else:
        dealt = dealt.withColumn("side", F.lit(0).cast("long")).withColumn("sub", F.lit(0).cast("long")).withColumn("across", F.lit(False))
    out = dealt.repartition(parts(spark), "key", "sub").sortWithinPartitions("key", "sub").mapInArrow(released(found), "a long, b long, n long")
    out = written(out, "links")
    return out.groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n")), out.select("a", "b").where("a <> b").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, width: float = 2.0, miss: float = 1e-3, seed: int = 11, hot: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing. Equal vectors are compared once and count as links of each other;
    rows that share an id but not a vector are vectors each. Rows without an id take part: a class that
    has no id at all has none to give (null), and its rows are kept. Vectors of other dimensions have no cosine.
    Other columns are not read. No rows: no rows.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = base.where(sound())
    # a number of their own for distinct vectors; the written table holds it fast
    distinct = written(ok.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    counted, edges = links(distinct.select(F.col("node").alias("vec_id"), "embedding", "copies"), cosine, width, miss, seed, hot)
    joined = components(edges, "vector_classes")
    met = distinct.join(counted.withColumnRenamed("vec_id", "node"), "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = met.groupBy("component").agg(F.min("rep").alias("component_id"))
    solved = met.join(lowest, "component").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = ok.join(solved, "embedding").select("vec_id", "n_links", "component_id")
    rest = base.where(~sound()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
