"""Operators on vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispan.llm import ann, vector_dedup
from tests.llm import brute

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((260, 24))
    near = base[:40].repeat(3, axis=0) + rng.standard_normal((120, 24)) * 0.08
    x = np.concatenate((base, near, base[:5], base[5:8] * 2)).astype(np.float32)
    out = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    out += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None, *[1.0] * 23], 1), (1004, [], 1), (1005, [float("inf")] * 24, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    return [*out, out[7]]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def _good(rows):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]


@pytest.mark.parametrize("hot", [4096, 3])
def test_links_are_brute_force(table, rows, hot):
    got = vector_dedup.near_duplicates(table.withColumn("n", F.lit(1)), 0.9, hot=hot, miss=1e-6).collect()
    good = _good(rows)
    pairs = [(a, b) for a in range(len(good)) for b in range(a) if len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.9]
    n = np.zeros(len(good), int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    own = brute.joined(len(good), pairs)
    low = {}
    for (i, _), c in zip(good, own, strict=True):
        low[c] = min(low.get(c, i), i)
    want = [(i, int(k), low[c]) for (i, _), k, c in zip(good, n, own, strict=True)] + [(i, 0, i) for i in range(1000, 1006)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (None, [-1.0, 0.0], 0), (None, [-1.0, 0.02], 0), (None, [0.01, 1.0], 0), (None, None, 0), (1, [1.0, 0.0], 0)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.9, miss=1e-6).collect()
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 1, 1, False), (None, 0, None, True), (1, 2, 1, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.near_duplicates(none).count() == 0
    assert ann.search(none, none).count() == 0


def test_more_tables_for_more_vectors():
    k1, t1 = vector_dedup.layout(1000, 0.9)
    k2, t2 = vector_dedup.layout(1_000_000, 0.9)
    assert t2 < vector_dedup.layout(1_000_000, 0.9, bucket=32)[1]
    assert k2 > k1 and t2 > t1
    near = vector_dedup.collide(np.sqrt(0.2), 2.0)
    assert (1 - near**k2) ** t2 <= 1e-3


def test_search_recall_and_scores(table, rows):
    got = ann.search(table.withColumn("dim", F.lit(1)), table.where("vec_id % 20 = 0"), 10, shard_rows=100).collect()
    good = _good(rows)
    hit = total = 0
    for q, v in [(i, v) for i, v in good if i % 20 == 0]:
        own = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != q and len(w) == len(v))[:10]
        found = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        exact = {j: d for d, j in own}
        hit += len({j for _, j, _ in found} & set(exact))
        total += len(own)
        for _, j, s in found:
            assert s == pytest.approx(float(np.sqrt(((v - dict(good)[j]) ** 2).sum())))
    assert hit / total > 0.95


def test_ties_at_the_last_rank_go_to_the_smaller_id(spark):
    """Vectors at one distance in several shards; and vectors of another dimension in the same shards."""
    ring = [(i, [float(np.cos(a)), float(np.sin(a))], 0) for i, a in enumerate(np.linspace(0, 2 * np.pi, 48, endpoint=False), 1)]
    same = [(100 + i, [2.0, 0.0], 0) for i in range(30)] + [(200 + i, [1.0, 0.0, float(i)], 0) for i in range(9)]
    rows = spark.createDataFrame([(0, [3.0, 0.0], 0), *ring, *same], SCHEMA)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(rows, rows.where("vec_id IN (0, 200)"), 10, shard_rows=12).collect()}
    assert [got[0, k] for k in range(1, 11)] == [(100 + i, 1.0) for i in range(10)]
    assert [got[200, k] for k in range(1, 9)] == [(200 + i, float(i)) for i in range(1, 9)]


def test_few_candidates_all_come(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, [1.0, 1.0], 0)], SCHEMA)
    got = sorted(tuple(r) for r in ann.search(few, few.where("vec_id = 0"), 10).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == 0.0
