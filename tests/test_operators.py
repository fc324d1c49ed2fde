"""Operators on small tables, and properties of spans."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispan.functions import diagnostics, naming, spans
from lexispan.operators import rewrite

FILES = "file_path string, content string"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="aé\n🙂b", max_size=30), min_size=1, max_size=6))
def test_line_index_and_positions(spark, texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], FILES)
    got = {(r.file_path, r.line_no): (r.byte_start, r.n_bytes) for r in spans.line_index(rows).collect()}
    want = {}
    for i, t in enumerate(texts):
        at = 0
        for n, line in enumerate(t.encode().split(b"\n")):
            want[str(i), n + 1] = (at, len(line))
            at += len(line) + 1
    assert got == want
    found = {(r.file_path, r.byte_start) for r in spans.literal_positions(rows, "aé").collect()}
    assert found == {(str(i), m) for i, t in enumerate(texts) for m in _places(t.encode(), "aé".encode())}


def _places(data, needle):
    at, out = data.find(needle), []
    while at >= 0:
        out.append(at)
        at = data.find(needle, at + len(needle))
    return out


def test_offsets_to_lines_both_ways(spark):
    rows = spark.createDataFrame([("a", "é\nxy\n\nz")], FILES)
    at = spark.createDataFrame([("a", n, n) for n in range(9)], "file_path string, k int, at bigint")
    joined = {r.k: (r.line_no, r.col) for r in spans.offset_to_line(at, spans.line_index(rows), "at").collect()}
    assert joined[0] == (1, 0) and joined[2] == (1, 2) and joined[3] == (2, 0) and joined[6] == (3, 0) and joined[7] == (4, 0)
    direct = {r.k: (r.line_no, r.col) for r in spans.locate(at.where("k NOT IN (1)"), rows, "at").collect()}
    assert all(direct[k] == joined[k] for k in direct)


def test_boundaries_and_slices(spark):
    rows = spark.createDataFrame([("é", 0, 2, True), ("é", 1, 1, False), ("é", 0, 1, False), ("", 0, 0, True), ("ab", 2, 1, False), ("ab", 0, 3, False)], "content string, s int, e int, ok boolean")
    assert all(r.ok == r.got for r in rows.withColumn("got", spans.utf8_ok("content", "s", "e")).collect())
    with pytest.raises(ValueError, match="empty"):
        spans.literal_positions(rows, "")


def test_problems_and_rewriting(spark):
    files = spark.createDataFrame([("a", "héllo world")], FILES)
    cols = "batch_no bigint, ordinal bigint, file_path string, byte_start bigint, byte_end bigint, content string"
    edits = [(0, 0, "a", 0, 1, "J"), (0, 1, "a", 1, 2, "x"), (0, 2, "b", 0, 1, ""), (0, 3, "a", 7, 99, ""), (0, 4, "a", 3, 6, "-"), (0, 5, "a", 5, 7, "")]
    got = {r.ordinal: r.problem for r in rewrite.checked(spark.createDataFrame(edits, cols), files).collect()}
    assert got == {0: None, 1: "utf8", 2: "missing_file", 3: "bounds", 4: None, 5: "overlap"}
    good = spark.createDataFrame([edits[0], (0, 1, "a", 6, 7, "_"), (0, 2, "a", 12, 12, "!")], cols)
    assert rewrite.rewritten(good, files).first().after == "Jéllo_world!"


def test_names(spark):
    rows = spark.createDataFrame([("/w/src/lib.rs", "crate"), ("/w/src/a/mod.rs", "crate::a"), ("/w/src/a/b.rs", "crate::a::b"), ("/w/src/main.rs", "crate"), ("/w/tests/t.rs", "crate::tests::t")], "p string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", naming.module_path("/w", "p")).collect())
    one = spark.createDataFrame([("crate::a::b", "crate::a"), ("crate", None)], "m string, want string").withColumn("got", naming.parent_module("m"))
    assert all(r.got == r.want for r in one.collect())
    assert [naming.language_of(p) for p in ("a/x.rs", ".rs", "x", "y.tsx", "z.H")] == ["rust", None, None, "typescript", None]


@pytest.mark.parametrize(
    ("tool", "file", "output", "want"),
    [
        ("rust", "", "error: no place\nnothing", []),
        ("rust", "", "error[E1]: m\n --> a.rs:1:2\nhelp: try\nwarning: w\n --> b.rs:3:4", [("error", "a.rs", 1, 2, "m", "E1", "try"), ("warning", "b.rs", 3, 4, "w", None, None)]),
        ("c", "", "test.c:3:5: error: expected ';'", [("error", "test.c", 3, 5, "error: expected ';'", None, None)]),
        ("java", "Main.java", "Main.java:3: error: bad", [("error", "Main.java", 3, 0, "bad", None, None)]),
        ("java", "Main.java", "odd output", [("error", "Main.java", 0, 0, "odd output", None, None)]),
        ("javascript", "test.js", "test.js:2 (5) SyntaxError: x", [("error", "test.js", 2, 5, "SyntaxError: x", None, None)]),
        ("typescript", "test.ts", "test.ts(2,5): error TS1002: Unterminated", [("error", "test.ts", 2, 5, "Unterminated", "TS1002", None)]),
        ("python", "test.py", '  File "test.py", line 1\n    x\nSyntaxError: invalid syntax', [("error", "test.py", 1, 0, "invalid syntax", None, None)]),
        ("python", "test.py", "SyntaxError: alone", [("error", "test.py", 0, 0, "alone", None, None)]),
    ],
)
def test_diagnostics(spark, tool, file, output, want):
    runs = spark.createDataFrame([("r", file, output)], "run_id string, file string, output string")
    rows = diagnostics.PARSERS[tool](runs).orderBy("nth").collect()
    assert [(r.level, r.file, r.line, r.column, r.message, r.code, r.note) for r in rows] == want


def test_verdict_is_of_the_batch(spark):
    rows = rewrite.verdict(spark.createDataFrame([(1, True), (1, False), (2, True)], "batch_no int, is_valid boolean"))
    assert rows.where("applied").select(F.collect_set("batch_no")).first()[0] == [2]


def test_covered_points(spark):
    spans_ = spark.createDataFrame([("a", 2, 9), ("a", 3, 4), ("a", 12, 12), ("b", 0, 1), (None, 0, 99)], "k string, byte_start bigint, byte_end bigint")
    points = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(14)], "k string, byte_start bigint")
    got = sorted((r.k, r.byte_start) for r in spans.covered(points, spans_, ["k"]).where("covered").collect())
    assert got == [("a", i) for i in range(2, 9)] + [("b", 0)]


def test_many_edits_of_one_file(spark):
    """Edits, checks and previews of thousands of edits in one text: bytes are made once, lines come from one sort."""
    n = 6000
    files = spark.createDataFrame([("a", "xé\n" * n)], FILES)
    cols = "batch_no bigint, ordinal bigint, file_path string, byte_start bigint, byte_end bigint, content string"
    edits = spark.range(n).selectExpr("0L AS batch_no", "id AS ordinal", "'a' AS file_path", "id * 4 AS byte_start", "id * 4 + 1 AS byte_end", "'yy' AS content").to(spark.createDataFrame([], cols).schema)
    assert rewrite.checked(edits, files).where("problem IS NOT NULL").count() == 0
    assert rewrite.rewritten(edits, files).first().after == "yyé\n" * n
    seen = rewrite.preview(edits, files)
    assert seen.where("line_start <> ordinal + 1 OR lines_removed <> 1 OR bytes_added <> 2").count() == 0 and seen.count() == n
