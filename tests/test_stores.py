"""Suffix index, stored labels and the stream of versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexispan.operators import extract, labels
from lexispan.sources import facts, suffixes
from lexispan.streaming import versions


def test_names_by_suffix(spark, tmp_path):
    rng = random.Random(4)
    names = ["::".join(rng.choice(["crate", "a", "ab", "b", "α"]) for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["", "a::", None]
    suffixes.build(spark.createDataFrame(list(enumerate(names)), "id int, name string"), str(tmp_path / "x"), parts=7)
    fits = lambda n, s: n is not None and (n == s or n.endswith("::" + s))
    asked = ["a", "ab::b", "b::a", "α", "crate::a::b", "nowhere", "", "ab"]
    for s in asked:
        assert sorted(r.id for r in suffixes.by_suffix(spark, str(tmp_path / "x"), s).collect()) == [i for i, n in enumerate(names) if fits(n, s)], s
    many = suffixes.by_suffixes(spark, str(tmp_path / "x"), spark.createDataFrame([(s,) for s in [*asked, "a"]], "suffix string"))
    assert sorted((r.suffix, r.id) for r in many.collect()) == sorted((s, i) for s in asked for i, n in enumerate(names) if fits(n, s))
    plan = suffixes.by_suffix(spark, str(tmp_path / "x"), "ab::b")._jdf.queryExecution().toString()
    assert "StringStartsWith(reversed_n" in plan and "GreaterThanOrEqual(reversed_name,b::ab::)" in plan


def test_label_queries_read_their_labels_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, label) for i in range(30) for label in ("even" if i % 2 == 0 else "odd", f"m{i % 3}")], "entity_id bigint, label string")
    facts.save({"entity_labels": rows}, str(tmp_path))
    found = labels.all_labels(facts.load(spark, str(tmp_path), "entity_labels"), ["even", "m1"])
    assert sorted(r.entity_id for r in found.collect()) == [4, 10, 16, 22, 28]
    assert "PartitionFilters: [label" in found._jdf.queryExecution().toString().replace("isnotnull(label", "label")


@pytest.fixture
def feed(spark, tmp_path):
    began = datetime(2024, 5, 1)

    def put(*rows):
        data = [(f"/w/{name}.py", text, began + timedelta(minutes=at)) for name, text, at in rows]
        spark.createDataFrame(data, versions.FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))

    def run():
        query = versions.index_versions(spark, str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        rows = extract.table(versions.current(spark, str(tmp_path / "out")), "symbols").collect()
        return sorted((r.file_path[3:-3], r.name) for r in rows)

    return put, run


def test_versions_replace_and_delete(spark, feed, tmp_path):
    put, run = feed
    code = "def {}(): pass\n".format
    put(("a", code("one"), 1), ("b", code("two"), 1), ("c", code("three"), 1), ("d", code("four"), 1))
    assert run() == [("a", "one"), ("b", "two"), ("c", "three"), ("d", "four")]
    # changed twice in one batch, deleted, the same again, late; then a stream that starts again from its checkpoint
    put(("a", code("later"), 3), ("a", code("between"), 2), ("b", None, 2), ("c", code("three"), 5), ("d", code("stale"), 0), ("e", code("five"), 2))
    assert run() == [("a", "later"), ("c", "three"), ("d", "four"), ("e", "five")]
    told = {(r.file_path[3:-3], r.state) for r in spark.read.parquet(str(tmp_path / "out" / "log")).where("run = (SELECT max(run) FROM VALUES (1) t(run))").collect()}
    assert told == {("a", "changed"), ("b", "deleted"), ("e", "new")}
    put(("b", code("again"), 4), ("e", None, 3), ("zz", None, 1))
    assert run() == [("a", "later"), ("b", "again"), ("c", "three"), ("d", "four")]
    assert run() == [("a", "later"), ("b", "again"), ("c", "three"), ("d", "four")]
    assert {r.file_path for r in versions.standing(spark, str(tmp_path / "out")).where(F.col("state") == "new").collect()} == {"/w/b.py", "/w/c.py", "/w/d.py"}
