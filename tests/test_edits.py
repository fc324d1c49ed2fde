"""The gram index, composed scripts and journalled commits."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lexispan.errors import SpanError
from lexispan.functions.spans import literal_positions
from lexispan.operators import rewrite, script
from lexispan.sources import grams, journal

FILES = "file_path string, content string"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(f"f{i}", "".join(rng.choice("abé\n") for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [("needle", "xx wrench yy wrench"), ("other", "wren chisel"), ("short", "ab"), ("empty", ""), ("none", None), ("wide", "🙂ß\n🙂ß")]
    files = spark.createDataFrame(rows, FILES)
    path = str(tmp_path_factory.mktemp("grams"))
    grams.build(files, path, 16)
    return files, path


@pytest.mark.parametrize("needle", ["wrench", "ab", "a", "aba", "é\na", "🙂ß\n", "absent", "chi"])
def test_indexed_find_equals_a_full_one(spark, indexed, needle):
    files, path = indexed
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(grams.find(spark, path, needle)) == rows(literal_positions(files, needle))


def test_find_reads_candidate_blocks_only(spark, indexed):
    files, path = indexed
    blocks = grams.candidates(spark, path, "wrench")
    held = {r.block for r in grams.texts(spark, path).where("file_path = 'needle'").collect()}
    assert held <= set(blocks) and len(blocks) <= 2 and grams.candidates(spark, path, "absent") == [] and grams.candidates(spark, path, "ab") is None
    plan = grams.find(spark, path, "wrench")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*block#\d+ (IN|INSET|=)|PartitionFilters: \[[^]]*block#\d+", plan) and "StringContains(content,wrench)" in plan
    read = spark.read.parquet(f"{path}/texts").where(F.col("block").isin(blocks))
    assert read.count() < files.count() / 4
    lists = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin("wre", "ren"))
    assert "PushedFilters: [In(gram" in lists._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        grams.find(spark, path, "")


def plainly(text: bytes, steps):
    for edits in steps:
        for a, b, new in sorted(edits, reverse=True):
            text = text[:a] + new + text[b:]
    return text


def test_composed_scripts_equal_steps():
    rng = random.Random(9)
    for _ in range(400):
        text = bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(40)))
        steps, now = [], text
        for _ in range(rng.randrange(6)):
            at, edits = 0, []
            for _ in range(rng.randrange(4)):
                a = rng.randint(at, len(now))
                b = rng.randint(a, min(len(now), a + 6))
                if edits and a == edits[-1][0]:
                    continue
                edits.append((a, b, bytes(rng.choice(b"XYZ") for _ in range(rng.randrange(4)))))
                at = b
            steps.append(edits)
            now = plainly(now, [edits])
        done = script.composed(steps, len(text))
        assert plainly(text, [done]) == now
        assert all(x[1] <= y[0] for x, y in zip(done, done[1:])) and all(0 <= a <= b <= len(text) for a, b, _ in done)


def test_scripts_that_cannot_be_done():
    for steps in ([[(0, 3, b""), (2, 4, b"")]], [[(0, 9, b"")]], [[(0, 5, b"")], [(1, 2, b"")]], [[(-1, 0, b"")]]):
        with pytest.raises(ValueError, match="step"):
            script.composed(steps, 5)
    assert script.composed([[(0, 5, b"")], [(0, 0, b"new")]], 5) == [(0, 5, b"new")] and script.composed([], 5) == []


def test_scripts_over_files(spark):
    files = spark.createDataFrame([("a", "one two"), ("b", "é"), ("c", "x"), ("d", None)], FILES)
    rows = [("a", 1, 0, 3, "1"), ("a", 2, 1, 2, "_"), ("a", 3, 0, 2, ""), ("b", 1, 0, 0, "ö"), ("b", 2, 2, 4, "e"), ("c", 1, 0, 9, ""), ("gone", 1, 0, 0, "y"), ("a", 3, 5, 5, "!")]
    steps = spark.createDataFrame(rows, "file_path string, step int, byte_start bigint, byte_end bigint, content string")
    assert {r.file_path: r.after for r in script.scripted(steps, files).collect()} == {"a": "two!", "b": "öe"}
    told = {r.file_path: r.problem for r in script.compose(steps, files).where("problem IS NOT NULL").collect()}
    assert set(told) == {"c", "gone"} and "step 0" in told["c"] and "missing" in told["gone"]
    edits = script.compose(steps, files).where("file_path = 'a'").drop("problem")
    assert rewrite.checked(edits, files).where("problem IS NOT NULL").count() == 0


@pytest.fixture
def place(tmp_path):
    for i in range(9):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"{i}.txt").write_text(f"old {i}")
    os.chmod(tmp_path / "d0" / "0.txt", 0o640)
    return tmp_path


def changes(spark, place, stale=()):
    rows = [(str(p), hashlib.sha256(b"?" if p.stem in stale else p.read_bytes()).hexdigest(), p.read_text().replace("old", "new é")) for p in sorted(place.rglob("*.txt"))]
    return spark.createDataFrame(rows, "file_path string, before_sha256 string, after string").repartition(3)


def state(place):
    left = [p for p in place.rglob("*") if p.name.startswith(".")]
    return {p.read_text().split()[0] for p in place.rglob("*.txt")}, left


def test_commit_writes_all(spark, place):
    seen = []
    assert journal.commit(spark, changes(spark, place), str(place), lambda: seen.append(state(place)[0])) == 9
    assert state(place) == ({"new"}, []) and seen == [{"new"}] and (place / "d0" / "0.txt").stat().st_mode & 0o777 == 0o640


def test_commit_of_stale_files_or_with_a_failed_gate_writes_none(spark, place):
    with pytest.raises(SpanError, match="changed"):
        journal.commit(spark, changes(spark, place, stale=("4",)), str(place))
    assert state(place) == ({"old"}, [])

    def gate():
        assert state(place)[0] == {"new"}
        raise SpanError("CompilerValidationFailed", "no")

    with pytest.raises(SpanError, match="no"):
        journal.commit(spark, changes(spark, place), str(place), gate)
    assert state(place) == ({"old"}, [])
    rows = changes(spark, place)
    (place / "d1" / "1.txt").unlink()
    with pytest.raises(SpanError):
        journal.commit(spark, rows, str(place))
    assert state(place) == ({"old"}, [])


@pytest.mark.parametrize("marker", [None, "plain", "gated", "passed"])
@pytest.mark.parametrize("renamed", [0, 4, 9])
def test_recovery_leaves_old_or_new(spark, place, marker, renamed):
    """A crash after so many renames, with the marker there or not, and a gate to pass or passed."""
    folder = os.path.join(str(place), journal.FOLDER, "op1")
    os.makedirs(folder)
    rows = journal.stage(changes(spark, place), folder, "op1")
    if marker:
        journal._mark(folder, "COMMIT", {"gated": marker != "plain"})
    if marker == "passed":
        journal._mark(folder, "GATED")
    for r in rows.orderBy("file_path").limit(renamed).collect() if marker else ():
        journal._place(r.file_path, r.staged, r.original)
    done = marker in ("plain", "passed")
    assert journal.recover(spark, str(place)) == {"op1": "completed" if done else "taken back"}
    assert state(place) == ({"new" if done else "old"}, []) and journal.recover(spark, str(place)) == {}


def test_recovery_when_staging_was_cut_short(spark, place):
    folder = os.path.join(str(place), journal.FOLDER, "op2")
    os.makedirs(folder)
    p = str(place / "d0" / "0.txt")
    journal._stage_one(p, hashlib.sha256(b"old 0").hexdigest(), "new 0", "op2")
    assert journal.recover(spark, str(place)) == {"op2": "taken back"} and state(place) == ({"old"}, [])


def test_recovery_by_command(spark, place, capsys):
    from lexispan import cli

    folder = os.path.join(str(place), journal.FOLDER, "op3")
    os.makedirs(folder)
    journal.stage(changes(spark, place), folder, "op3")
    journal._mark(folder, "COMMIT", {"gated": False})
    assert cli.main(["recover", "--root", str(place)], spark) == 0
    assert '"op3": "completed"' in capsys.readouterr().out and state(place) == ({"new"}, [])
