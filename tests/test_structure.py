"""Trees, innermost nodes and bound references against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lexispan.functions import naming
from lexispan.operators import binding, extract, nesting, pattern, references, resolve


def plain_tree(marks):
    """(node_id, parent_id, name, depth, start, end, is_closed) of marks (start, end, name, mark) in order, with stacks."""
    paired, stacks = {}, {}
    for i, (_, _, name, mark) in enumerate(marks):
        if mark > 0:
            stacks.setdefault(name, []).append(i)
        elif mark < 0 and stacks.get(name):
            j = stacks[name].pop()
            paired[i] = paired[j] = True
    stack, close = [], {}
    for i in sorted(paired):
        if marks[i][3] > 0:
            stack.append(i)
        else:
            j = stack.pop()
            if marks[j][2] == marks[i][2]:
                close[j] = i
    out, held = [], []
    for i, (start, end, name, mark) in enumerate(marks):
        while held and held[-1][1] < i:
            held.pop()
        if mark < 0:
            continue
        node = len(out)
        out.append((node, held[-1][0] if held else None, name, len(held) + 1, start, marks[close[i]][1] if i in close else end, i in close or mark == 0))
        if i in close:
            held.append((node, close[i]))
    return out


def test_tree_of_any_marks(spark):
    rng = random.Random(17)
    files, rows = {}, []
    for f in range(120):
        n, at = rng.randrange(0, 30), 0
        own = []
        for _ in range(n):
            at += rng.randrange(3)
            own.append((at, at + 2, rng.choice("abc"), rng.choice([1, 1, -1, -1, 0])))
            at += 2
        files[f"f{f}"] = own
        rows += [(f"f{f}", *m) for m in own]
    got = nesting.tree(spark.createDataFrame(rows, "file_path string, byte_start bigint, byte_end bigint, name string, mark bigint").repartition(5)).collect()
    want = {(f, *n) for f, own in files.items() for n in plain_tree(own)}
    assert {(r.file_path, r.node_id, r.parent_id, r.name, r.depth, r.byte_start, r.byte_end, r.is_closed) for r in got} == want and len(got) == len(want)


def test_marks_of_markup(spark):
    html = '<!DOCTYPE html><P class="a>b">é<br/>x<!-- <b> --><script>if (a<b) "</p>"</script ><a href=\'q\'>y</a></p></i><img src=x><b>z'
    rows = nesting.html_marks(spark.createDataFrame([("f", html), ("g", ""), ("h", None), ("i", "a < b and <3")], "file_path string, content string")).collect()
    data = html.encode()
    assert [(r.name, r.mark, data[r.byte_start : r.byte_end].decode()) for r in sorted(rows, key=lambda r: r.byte_start)] == [
        ("!", 0, "<!DOCTYPE html>"), ("p", 1, '<P class="a>b">'), ("br", 0, "<br/>"), ("!--", 0, "<!-- <b> -->"), ("script", 0, '<script>if (a<b) "</p>"</script >'),
        ("a", 1, "<a href='q'>"), ("a", -1, "</a>"), ("p", -1, "</p>"), ("i", -1, "</i>"), ("img", 0, "<img src=x>"), ("b", 1, "<b>"),
    ]


def test_innermost_of_nested_spans(spark):
    rng = random.Random(3)
    spans, points = [], []

    def grow(f, a, b, depth):
        while a + 2 < b and depth < 6:
            s = rng.randrange(a, b - 1)
            e = rng.randrange(s + 1, b + 1)
            spans.append((f, s, e, len(spans)))
            grow(f, s, e, depth + 1 + rng.randrange(2))
            a = e

    for f in "abcd":
        grow(f, 0, 60, 0)
        points += [(f, at) for at in range(62)] + [(f, 30)]
    points += [("none", 4), (None, 4)]
    table = spark.createDataFrame(spans, "k string, byte_start bigint, byte_end bigint, tag int")
    nodes = nesting.nested(table, ["k"])
    assert nodes.count() == len(spans)
    tags = {(r.k, r.node_id): (r.tag, r.byte_start, r.byte_end) for r in nodes.collect()}
    for r in nodes.where("parent_id IS NOT NULL").collect():
        _, s, e = tags[r.k, r.parent_id]
        assert s <= r.byte_start and r.byte_end <= e and (s, e) != (r.byte_end, r.byte_end)
    got = nesting.innermost(spark.createDataFrame(points, "k string, byte_start bigint"), nodes, ["k"]).collect()
    assert len(got) == len(points)
    for r in got:
        held = [(e - s, -t) for f, s, e, t in spans if f == r.k and s <= r.byte_start < e]
        want = min(held)[0] if held else None
        assert (None if r.node_id is None else tags[r.k, r.node_id][2] - tags[r.k, r.node_id][1]) == want


def test_outside_kinds_minds_the_innermost_node(spark):
    nodes = spark.createDataFrame([("f", 0, None, 1, "block", 0, 50), ("f", 1, 0, 2, "comment", 10, 20), ("f", 2, 1, 3, "code", 14, 16)], "file_path string, node_id bigint, parent_id bigint, depth bigint, kind string, byte_start bigint, byte_end bigint")
    found = spark.createDataFrame([("f", at) for at in (5, 10, 15, 19, 20, 60)] + [("g", 12)], "file_path string, byte_start bigint")
    assert sorted((r.file_path, r.byte_start) for r in pattern.outside_kinds(found, nodes, ["comment"]).collect()) == [("f", 5), ("f", 15), ("f", 20), ("f", 60), ("g", 12)]


#: A small workspace: a module with two functions, one that imports by name, one by glob, one by path, and local names that hide.
SOURCES = {
    "/w/src/tide.rs": "pub fn rise(by: u32) -> u32 {\n    fall(by)\n}\n\npub fn fall(by: u32) -> u32 {\n    let rest = by;\n    rest\n}\n",
    "/w/src/quay.rs": "use crate::tide::rise;\n\npub fn load() {\n    rise(1);\n    let rise = 4;\n    rise(2);\n}\n\nfn spare() {\n    rise(3);\n    load();\n    load();\n}\n",
    "/w/src/pier.rs": "use crate::tide::*;\n\nfn wait() {\n    fall(9);\n    crate::tide::rise(5);\n    crate::tide::ebb(5);\n    nowhere(7);\n}\n",
}


@pytest.fixture(scope="module")
def workspace(spark):
    files = extract.source_files(spark.createDataFrame(list(SOURCES.items()), "file_path string, content string"))
    rows = extract.facts(files).persist()
    t = {n: extract.table(rows, n) for n in extract.TABLES}
    t["modules"] = files.select("file_path", naming.module_path("/w", "file_path").alias("module_path"))
    t["bound"] = binding.bind(t["identifiers"], t["scopes"], t["scope_symbols"], t["symbols"], resolve.import_targets(t["imports"], t["modules"]), t["modules"]).persist()
    return t


def test_every_identifier_is_bound_once(workspace):
    bound = workspace["bound"].collect()
    assert len(bound) == workspace["identifiers"].count()
    text = {f: s.encode() for f, s in SOURCES.items()}
    told = {(r.file_path[7:], text[r.file_path][: r.byte_start].count(b"\n") + 1, r.name): (r.origin, r.target_file and r.target_file[7:], r.target_name) for r in bound if r.parent_kind == "call"}
    assert told == {
        ("tide.rs", 2, "fall"): ("file", "tide.rs", "fall"), ("quay.rs", 4, "rise"): ("import", "tide.rs", "rise"), ("quay.rs", 6, "rise"): ("local", None, None), ("quay.rs", 10, "rise"): ("import", "tide.rs", "rise"),
        ("quay.rs", 11, "load"): ("file", "quay.rs", "load"), ("quay.rs", 12, "load"): ("file", "quay.rs", "load"), ("pier.rs", 4, "fall"): ("glob", "tide.rs", "fall"), ("pier.rs", 5, "rise"): ("path", "tide.rs", "rise"),
        ("pier.rs", 6, "ebb"): ("unbound", None, None), ("pier.rs", 7, "nowhere"): ("unbound", None, None),
    }


def test_references_of_all_symbols_are_those_of_each(workspace):
    """One plan for all symbols finds what a search for each symbol finds."""
    t = workspace
    every = {}
    for r in binding.references(t["bound"]).where("target_kind = 'function'").collect():
        every.setdefault((r.target_file, r.target_name), set()).add((r.file_path, r.byte_start, r.byte_end))
    for s in t["symbols"].where("kind = 'function'").collect():
        target = {"file_path": s.file_path, "name": s.name, "kind": s.kind, "byte_start": s.byte_start, "byte_end": s.byte_end, "is_private": s.visibility.level == "private"}
        one = references.find(target, t["identifiers"], t["scopes"], t["scope_symbols"], t["imports"], t["modules"]).collect()
        assert every.get((s.file_path, s.name), set()) == {(r.file_path, r.byte_start, r.byte_end) for r in one}, s.name


def test_calls_name_caller_and_callee(workspace):
    got = {(r.caller, r.callee, r.n_calls) for r in binding.calls(workspace["bound"], workspace["symbols"]).collect()}
    assert got == {("rise", "fall", 1), ("load", "rise", 1), ("spare", "rise", 1), ("spare", "load", 2), ("wait", "fall", 1), ("wait", "rise", 1)}


def test_index_writes_references_and_calls(spark, tmp_path):
    files = extract.source_files(spark.createDataFrame(list(SOURCES.items()), "file_path string, content string"))
    assert extract.index(files, str(tmp_path / "db"), root="/w") == 5
    refs, calls = (spark.read.parquet(f"{tmp_path}/db/{n}") for n in ("references", "calls"))
    assert {(r.target_name, r.n) for r in refs.where("target_kind = 'function'").groupBy("target_name").agg(F.count("*").alias("n")).collect()} == {("rise", 3), ("fall", 2), ("load", 2)}
    edges = {(r.from_id, r.to_id) for r in calls.collect()}
    names = {r.entity_id: r.name for r in spark.read.parquet(f"{tmp_path}/db/symbols").collect()}
    assert {(names[a], names[b]) for a, b in edges} == {("rise", "fall"), ("load", "rise"), ("spare", "rise"), ("spare", "load"), ("wait", "fall"), ("wait", "rise")}
