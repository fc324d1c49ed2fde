"""Commands over temporary workspaces."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from lexispan import cli
from lexispan.errors import SpanError
from lexispan.operators import extract, gates
from lexispan.plans import commands as c
from lexispan.sources import backup, files
from lexispan.streaming import incremental
from lexispan.streaming.incremental import index_stream


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "Cargo.toml").write_text("[package]\nname='x'\n")
    src = tmp_path / "src"
    src.mkdir()
    (src / "lib.rs").write_text("pub fn ballast() {}\nconst TONS: i32 = 42;\n// ballast 42\nfn load() { ballast(); }\n")
    (src / "a.rs").write_text("use crate::ballast;\nfn trim() { ballast(); }\n")
    (src / "b.rs").write_text("fn list() { ballast(); }\n")
    return tmp_path


def test_patch_preview_backup_undo(spark, tree):
    lib, new = tree / "src/lib.rs", "pub fn ballast() { 1; }"
    before = lib.read_text()
    p = c.patch(spark, str(lib), "ballast", new, preview=True)["data"]
    assert lib.read_text() == before and p["preview"]["lines_added"] == 1 and p["preview"]["bytes_removed"] == 19
    done = c.patch(spark, str(lib), "ballast", new, create_backup=True, metadata='{"a": 1}')["data"]
    assert lib.read_text().startswith(new) and done["metadata"] == {"a": 1} and done["files"][0]["before_hash"] != done["files"][0]["after_hash"]
    assert backup.read_manifest(spark, done["backup_manifest"]).count() == 1
    assert c.undo(spark, done["backup_manifest"])["data"]["files_restored"] == 1 and lib.read_text() == before


def test_undo_checks_all_hashes_first(spark, tree):
    _, manifest = backup.save(str(tree), [str(tree / "src/a.rs"), str(tree / "src/b.rs")])
    (tree / "src/a.rs").write_text("changed")
    copy = next((tree / backup.FOLDER).rglob("b.rs"))
    copy.write_text("damaged")
    with pytest.raises(SpanError):
        backup.restore(manifest)
    assert (tree / "src/a.rs").read_text() == "changed"


def test_syntax_gate_leaves_files(spark, tree):
    lib = tree / "src/lib.rs"
    before = lib.read_text()
    with pytest.raises(SpanError) as e:
        c.patch(spark, str(lib), "ballast", "pub fn ballast( {")
    assert e.value.kind == "ParseValidationFailed" and lib.read_text() == before
    with pytest.raises(SpanError) as e:
        c.patch(spark, str(lib), "absent", "x")
    assert e.value.kind == "SymbolNotFound" and e.value.payload()["error"]["symbol"] == "absent"


def test_delete_takes_references_of_importers(spark, tree):
    done = c.delete(spark, str(tree / "src/lib.rs"), "ballast")["data"]
    assert done["references"] == 2 and done["files_modified"] == 2
    assert "ballast()" not in (tree / "src/a.rs").read_text() and "// ballast 42" in (tree / "src/lib.rs").read_text()
    assert "ballast()" in (tree / "src/b.rs").read_text()


def test_delete_warns_of_globs(spark, tree):
    (tree / "src/b.rs").write_text("use crate::*;\nfn list() { ballast(); }\n")
    done = c.delete(spark, str(tree / "src/lib.rs"), "ballast")["data"]
    assert done["references"] == 3 and "glob" in done["warnings"][0]


def test_every_bad_edit_is_told(spark, tree):
    batch = tree / "batch.json"
    batch.write_text(json.dumps({"batches": [{"replacements": [{"file": "src/b.rs", "start": 900 + i, "end": 990, "content": "x"} for i in range(30)]}]}))
    with pytest.raises(SpanError) as e:
        c.patch_batch(spark, str(batch))
    assert len(e.value.payload()["error"]["diagnostics"]) == 30


def test_compilers_run_after_the_write_and_undo_it(spark, tmp_path):
    good = tmp_path / "good.py"
    good.write_text("def row():\n    return 1\n")
    done = c.patch(spark, str(good), "row", "def row():\n    return 2", compilers=True)
    assert done["status"] == "ok" and "return 2" in good.read_text()
    before = good.read_text()
    with pytest.raises(SpanError) as e:  # it parses, but does not compile
        c.patch(spark, str(good), "row", "def row():\n    break", compilers=True)
    told = e.value.payload()["error"]["diagnostics"]
    assert e.value.kind == "CompilerValidationFailed" and told[0]["tool"] == "python" and "outside loop" in told[0]["message"] and "tool_version" in told[0]
    assert good.read_text() == before
    with pytest.raises(SpanError) as e:
        gates.analyzer_gate(str(tmp_path), str(tmp_path / "absent"))
    assert e.value.kind == "AnalyzerNotAvailable"
    gates.analyzer_gate(str(tmp_path), "off")


#: A file each language's own tool refuses though it keeps the rules of the syntax gate: name, source, function, a new one, what is wrong with it.
REFUSED = {
    "c": ("rig.c", "int haul(int n) { return n; }\n", "haul", "int haul(int n) { return n + slack; }", "slack"),
    "cpp": ("rig.cpp", "int haul(int n) { return n; }\n", "haul", "int haul(int n) { return std::string(n); }", "std"),
    "java": ("Rig.java", "class Rig { int haul(int n) { return n; } }\n", "haul", 'int haul(int n) { return "n"; }', "incompatible"),
    "javascript": ("rig.js", "function haul(n) { return n; }\n", "haul", "function haul(n) { await n; }", "await"),
}


@pytest.mark.parametrize("language", REFUSED)
def test_compilers_of_languages(spark, tmp_path, language):
    if not gates.tool_metadata(language)["tool_version"]:
        pytest.skip("the tool is not here")
    name, source, function, new, word = REFUSED[language]
    (tmp_path / name).write_text(source)
    if not gates.run_tool(str(tmp_path / name), language)[1]:
        pytest.skip("the tool does not work here")
    with pytest.raises(SpanError) as e:
        c.patch(spark, str(tmp_path / name), function, new, compilers=True)
    told = e.value.payload()["error"].get("diagnostics", [])
    assert e.value.kind == "CompilerValidationFailed" and told, str(e.value)
    assert (tmp_path / name).read_text() == source
    assert any(word in d["message"] for d in told) and all(d["tool"] == gates.TOOLS[language][0] and d["tool_path"] for d in told)
    if language != "javascript":
        assert told[0]["line"] == 1
    same = source[source.index("int haul") if language != "javascript" else 0 :].split("}")[0] + "}"
    assert c.patch(spark, str(tmp_path / name), function, same, compilers=True)["status"] == "ok"
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_cargo_checks_the_workspace(spark, tmp_path):
    if not gates.tool_metadata("rust")["tool_version"]:
        pytest.skip("cargo is not here")
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "rig"\nversion = "0.1.0"\nedition = "2021"\n')
    (tmp_path / "src").mkdir()
    lib = tmp_path / "src/lib.rs"
    lib.write_text("pub fn haul(n: u32) -> u32 { n }\n")
    if not gates.run_tool(str(lib), "rust", str(tmp_path))[1]:
        pytest.skip("cargo cannot check here")
    with pytest.raises(SpanError) as e:
        c.patch(spark, str(lib), "haul", "pub fn haul(n: u32) -> u32 { slack(n) }", compilers=True)
    assert e.value.kind == "CargoCheckFailed" and lib.read_text() == "pub fn haul(n: u32) -> u32 { n }\n"
    assert c.patch(spark, str(lib), "haul", "pub fn haul(n: u32) -> u32 { n + 1 }", compilers=True)["status"] == "ok" and "n + 1" in lib.read_text()


def test_analyzer_speaks_or_is_silent(tmp_path):
    for said, ok in (("", True), ("src/lib.rs:1:1: unresolved", False)):
        tool = tmp_path / f"analyzer{ok}"
        tool.write_text(f"#!/bin/sh\nprintf '{said}'\n")
        tool.chmod(0o755)
        if ok:
            gates.analyzer_gate(str(tmp_path), str(tool))
        else:
            with pytest.raises(SpanError) as e:
                gates.analyzer_gate(str(tmp_path), str(tool))
            assert e.value.kind == "AnalyzerFailed" and "unresolved" in e.value.payload()["error"]["diagnostics"][0]["message"]


def test_missing_tools_pass_and_say_so(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    assert gates.tool_metadata("rust") == {"tool": "cargo", "tool_path": None, "tool_version": None}
    said, found = gates.compiler_gate(spark, ["a.c", "b.c"], "c")
    assert [(x["is_valid"], x["tool_available"]) for x in said] == [(True, False)] * 2 and found.count() == 0


def test_batch_all_or_nothing(spark, tree):
    (tree / "new.txt").write_text("two")
    batch = tree / "batch.json"
    body = {"batches": [{"replacements": [{"file": "src/a.rs", "start": 0, "end": 3, "content": "use"}, {"file": "src/b.rs", "start": 0, "end": 2, "with": "new.txt"}]}]}
    batch.write_text(json.dumps(body))
    done = c.patch_batch(spark, str(batch), validate=False)["data"]
    assert len(done["files"]) == 2 and (tree / "src/b.rs").read_text().startswith("two list()")
    body["batches"][0]["replacements"][1] = {"file": "src/b.rs", "start": 0, "end": 9999, "content": "x"}
    body["batches"][0]["replacements"][0]["content"] = "USE"
    batch.write_text(json.dumps(body))
    with pytest.raises(SpanError) as e:
        c.patch_batch(spark, str(batch))
    assert e.value.kind == "InvalidSpan" and (tree / "src/a.rs").read_text().startswith("use")
    for bad in ({"batches": []}, {"batches": [{"replacements": []}]}, {"batches": [{"replacements": [{"file": "a", "start": 0, "end": 1}]}]}):
        batch.write_text(json.dumps(bad))
        with pytest.raises(SpanError) as e:
            files.read_batches(spark, str(batch))
        assert e.value.kind == "InvalidBatchSchema"


def test_plan_stops_at_the_first_failure(spark, tree):
    (tree / "w.rs").write_text("fn list() { 2; }")
    plan = tree / "plan.json"
    step = {"file": "src/b.rs", "symbol": "list", "kind": "function", "with": "w.rs"}
    plan.write_text(json.dumps({"steps": [step, step | {"symbol": "absent"}]}))
    with pytest.raises(SpanError) as e:
        c.run_plan(spark, str(plan))
    assert "step 2" in str(e.value) and (tree / "src/b.rs").read_text().startswith("fn list() { 2; }")
    for bad in ({"steps": []}, {"steps": [step | {"symbol": " "}]}, {"steps": [step | {"kind": "class"}]}):
        plan.write_text(json.dumps(bad))
        with pytest.raises(SpanError) as e:
            files.read_plan(spark, str(plan))
        assert e.value.kind == "InvalidPlanSchema"


def test_apply_files_leaves_comments(spark, tree):
    done = c.apply_files(spark, str(tree / "src/*.rs"), "42", "43")["data"]
    assert done["replacements"] == 1 and "const TONS: i32 = 43;\n// ballast 42" in (tree / "src/lib.rs").read_text()
    (tree / "src/x.odd").write_text("42")
    with pytest.raises(Exception, match="unknown language"):
        files.scan_glob(spark, str(tree / "src/*")).collect()


def test_index_query_get_and_cli(spark, tree, tmp_path, capsys):
    db = str(tmp_path / "db")
    assert cli.main(["index", "--root", str(tree), "--db", db], spark) == 0
    rows = c.query(spark, db, ["rust", "fn"], show_code=True)["data"]["symbols"]
    assert {r["name"] for r in rows} == {"ballast", "load", "trim", "list"} and all(r["code"].startswith(("fn", "pub fn")) for r in rows)
    assert c.query(spark, db, ["rust", "absent"], count=True)["data"]["counts"] == [{"label": "absent", "n_entities": 0}, {"label": "rust", "n_entities": 4}]
    one = next(r for r in rows if r["name"] == "list")
    assert c.get(spark, db, one["file_path"], one["byte_start"], one["byte_end"])["data"]["content"] == "fn list() { ballast(); }"
    capsys.readouterr()
    assert cli.main(["patch", "--file", "absent.rs", "--symbol", "s", "--with", str(tree / "Cargo.toml")], spark) == 1
    assert json.loads(capsys.readouterr().err)["error"]["kind"] == "Io"


def test_scan_skips(spark, tree):
    for d in ("target", ".git", "src/.hidden"):
        (tree / d).mkdir(parents=True)
        (tree / d / "x.rs").write_text("fn x() {}")
    assert {r.file_path.rsplit("/", 1)[1] for r in files.scan_rust(spark, str(tree)).collect()} == {"lib.rs", "a.rs", "b.rs"}


def test_stream_indexes_each_file_once(spark, tree, tmp_path):
    out, mark = str(tmp_path / "facts"), str(tmp_path / "mark")
    index_stream(spark, str(tree / "src"), out, mark).awaitTermination(120)
    n = spark.read.parquet(out).where("fact = 'symbols'").count()
    (tree / "src/c.rs").write_text("fn late() {}")
    index_stream(spark, str(tree / "src"), out, mark).awaitTermination(120)
    names = extract.table(spark.read.parquet(out), "symbols")
    assert n == 4 and names.count() == 5 and names.where("name = 'late'").count() == 1


def _names(spark, out):
    return sorted(r.name for r in extract.table(incremental.current(spark, out), "symbols").collect())


def test_refresh_minds_changed_and_deleted_files(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "facts")
    src.mkdir()
    for name, code in (("a.rs", "fn one() {}"), ("b.py", "def two(): pass\n"), ("__init__.py", "def start(): pass\n")):
        (src / name).write_text(code)
    assert incremental.refresh(spark, str(src), out) == {"new": 3, "changed": 0, "deleted": 0, "same": 0}
    assert _names(spark, out) == ["one", "start", "two"]
    (src / "a.rs").write_text("fn uno() {}\nfn eins() {}")
    (src / "b.py").unlink()
    (src / "c.c").write_text("int four() { return 4; }")
    assert incremental.refresh(spark, str(src), out) == {"new": 1, "changed": 1, "deleted": 1, "same": 1}
    assert _names(spark, out) == ["eins", "four", "start", "uno"]
    assert incremental.refresh(spark, str(src), out) == {"new": 0, "changed": 0, "deleted": 0, "same": 3}
    assert _names(spark, out) == ["eins", "four", "start", "uno"]


def test_globs(spark, tmp_path):
    for name in ("a.py", "p/__init__.py", "p/q/b.py", "p/_in/c.py", ".h/d.py", "p/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = lambda g: sorted(r.file_path[len(str(tmp_path)) + 1 :] for r in files.scan_glob(spark, f"{tmp_path}/{g}").collect())
    assert found("**/*.py") == ["a.py", "p/__init__.py", "p/_in/c.py", "p/q/b.py"]
    assert found("*.py") == ["a.py"] and found("p/?/[a-c].{py,rs}") == ["p/q/b.py"] and found("absent/*.py") == [] and found("a.py") == ["a.py"]


def test_executors_get_the_package(tmp_path):
    """Workers whose path lacks the repository still parse: the driver ships the package."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from lexispan.session import session
from lexispan.operators import extract, gates
spark = session(**{{"spark.ui.enabled": "false", "spark.master": "local[2]"}})
rows = extract.source_files(spark.createDataFrame([("a.rs", "fn one() {{}}")], "file_path string, content string"))
assert extract.table(extract.facts(rows), "symbols").first().name == "one"
assert gates.parse_gate(rows, "content").first().is_valid
print("parsed")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "parsed" in run.stdout, run.stderr[-2000:]
