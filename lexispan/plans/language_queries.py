"""Queries of the language parsers: over sources that hold the lines of pages and documents as remarks, and their words as names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions import diagnostics, naming
from lexispan.operators import extract, labels, pattern, references, resolve, rewrite
from lexispan.sources.scratch import written

_SOURCES = {
    "rust": ("src/tide.rs", "pub struct Buoy { depth: f64 }\nenum Swell { Low, High(u8) }\nmod charts {\n    pub(super) fn sound(lead: &Line, fathoms: u32) -> u32 { fathoms }\n}\npub trait Drift { fn lean(&self); }\nimpl Drift for Buoy { fn lean(&self) {} }\n"),
    "python": ("harbour/quay.py", "class Quay:\n    def moor(self, vessel, *, ropes=2):\n        def knot(kind):\n            return kind\n        return knot(vessel)\n\n\nasync def tow(barge: str, **opts):\n    return barge\n"),
    "cpp": ("keel.cpp", "namespace hull {\nclass Plank {\n  int width() const { return w; }\n};\nenum class Wood { Oak, Elm };\n}\ntemplate <class W>\nstruct Pair { W port; };\nstatic double heel(double angle, const Plank& p) { return angle; }\n"),
    "c": ("winch.c", "#include <math.h>\nstruct drum { int turns; };\nstruct drum *wind(struct drum *d, int turns) { d->turns += turns; return d; }\nstatic float pull(void) { return 1.5f; }\n"),
    "java": ("Ferry.java", "package lake;\npublic class Ferry {\n    private long fare = 3;\n    Ferry(long fare) { this.fare = fare; }\n    enum Deck { UPPER, LOWER }\n    static long total(long riders, long[] extras) { return riders; }\n}\n"),
    "javascript": ("gull.mjs", "export class Gull {\n  static hatch(egg) { return new Gull(egg); }\n  async glide(wind, { gust } = {}) { return wind; }\n}\nfunction* flock(size) { yield size; }\nlet wings = 2;\n"),
    "typescript": ("reef.ts", "export interface Coral { hue: string }\nexport type Shoal = Coral[] | null;\nnamespace Polyp {\n  export function bud(seed: Coral): { twin: Coral } { return { twin: seed }; }\n}\nenum Tint { Pale }\nclass Reef<C> { grow(days: number): Promise<C> { return wait(days); } }\n"),
}

#: Goldens: kind, qualified name, the declaration's text, parameters.
_SYMBOLS = {
    "rust": [
        ("struct", "crate::Buoy", "pub struct Buoy { depth: f64 }", ""), ("enum", "crate::Swell", "enum Swell { Low, High(u8) }", ""),
        ("module", "crate::charts", "mod charts {\n    pub(super) fn sound(lead: &Line, fathoms: u32) -> u32 { fathoms }\n}", ""), ("function", "crate::charts::sound", "pub(super) fn sound(lead: &Line, fathoms: u32) -> u32 { fathoms }", "lead,fathoms"),
        ("trait", "crate::Drift", "pub trait Drift { fn lean(&self); }", ""), ("impl", "crate::Buoy", "impl Drift for Buoy { fn lean(&self) {} }", ""), ("function", "crate::lean", "fn lean(&self) {}", ""),
    ],
    "python": [
        ("class", "module::Quay", "class Quay:\n    def moor(self, vessel, *, ropes=2):\n        def knot(kind):\n            return kind\n        return knot(vessel)", ""),
        ("function", "module::Quay::moor", "def moor(self, vessel, *, ropes=2):\n        def knot(kind):\n            return kind\n        return knot(vessel)", "vessel,ropes"),
        ("function", "module::Quay::moor::knot", "def knot(kind):\n            return kind", "kind"), ("function", "module::tow", "async def tow(barge: str, **opts):\n    return barge", "barge,opts"),
    ],
    "cpp": [
        ("namespace", "hull", "namespace hull {\nclass Plank {\n  int width() const { return w; }\n};\nenum class Wood { Oak, Elm };\n}", ""), ("class", "hull::Plank", "class Plank {\n  int width() const { return w; }\n}", ""),
        ("method", "hull::Plank::width", "int width() const { return w; }", ""), ("enum", "hull::Wood", "enum class Wood { Oak, Elm }", ""), ("template_class", "Pair", "template <class W>\nstruct Pair { W port; }", ""),
        ("function", "heel", "static double heel(double angle, const Plank& p) { return angle; }", "angle,p"),
    ],
    "c": [("struct", "drum", "struct drum { int turns; }", ""), ("function", "wind", "struct drum *wind(struct drum *d, int turns) { d->turns += turns; return d; }", "d,turns"), ("function", "pull", "static float pull(void) { return 1.5f; }", "")],
    "java": [
        ("class", "Ferry", "public class Ferry {\n    private long fare = 3;\n    Ferry(long fare) { this.fare = fare; }\n    enum Deck { UPPER, LOWER }\n    static long total(long riders, long[] extras) { return riders; }\n}", ""),
        ("field", "Ferry.fare", "private long fare = 3;", ""), ("constructor", "Ferry.Ferry", "Ferry(long fare) { this.fare = fare; }", "fare"), ("enum", "Ferry.Deck", "enum Deck { UPPER, LOWER }", ""),
        ("method", "Ferry.total", "static long total(long riders, long[] extras) { return riders; }", "riders,extras"),
    ],
    "javascript": [
        ("class", "Gull", "class Gull {\n  static hatch(egg) { return new Gull(egg); }\n  async glide(wind, { gust } = {}) { return wind; }\n}", ""), ("method", "Gull::hatch", "static hatch(egg) { return new Gull(egg); }", "egg"),
        ("method", "Gull::glide", "async glide(wind, { gust } = {}) { return wind; }", "wind,gust"), ("function", "flock", "function* flock(size) { yield size; }", "size"), ("variable", "wings", "let wings = 2;", ""),
    ],
    "typescript": [
        ("interface", "Coral", "interface Coral { hue: string }", ""), ("type_alias", "Shoal", "type Shoal = Coral[] | null;", ""), ("namespace", "Polyp", "namespace Polyp {\n  export function bud(seed: Coral): { twin: Coral } { return { twin: seed }; }\n}", ""),
        ("function", "Polyp::bud", "function bud(seed: Coral): { twin: Coral } { return { twin: seed }; }", "seed"), ("enum", "Tint", "enum Tint { Pale }", ""), ("class", "Reef", "class Reef<C> { grow(days: number): Promise<C> { return wait(days); } }", ""),
        ("method", "Reef::grow", "grow(days: number): Promise<C> { return wait(days); }", "days"),
    ],
}


#: How a remark begins.
_MARK = {"py": "#"}


def _remarks(text, mark: str):
    """The lines of a text as remarks of a source."""
    return F.concat(F.lit(f"{mark} "), F.replace(text, F.lit("\n"), F.lit(f"\n{mark} ")), F.lit("\n"))


def _remarks_sql(text: str, mark: str = "//") -> str:
    return f"'{mark} ' || replace({text}, chr(10), chr(10) || '{mark} ') || chr(10)"


def _size_sql(text: str) -> str:
    return f"octet_length(encode({text}))"


def _paged(spark: SparkSession, sf_dir: str, sources: list[tuple[str, str]]) -> DataFrame:
    """Sources (name, code) once for each page, whose lines come before the code as remarks."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html IS NOT NULL")
    each = [F.struct(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(f"/{name}")).alias("file_path"), F.concat(_remarks(F.col("html"), _MARK.get(name.rsplit(".", 1)[-1], "//")), F.lit(code)).alias("content")) for name, code in sources]
    return extract.source_files(pages.select(F.inline(F.array(*each))))


def _symbol_query(language: str):
    def run(spark, sf_dir):
        symbols = extract.table(extract.facts(_paged(spark, sf_dir, [_SOURCES[language]])), "symbols")
        return symbols.select("file_path", "kind", "fully_qualified", "byte_start", "byte_end", F.array_join("parameters", ",").alias("parameters"))

    return run


#: Sources with imports, and the facts of each: kind, path, names, glob, reexport.
_IMPORTS = {
    "log.rs": ("pub use crate::helm::{steer, wheel as w};\nuse super::deck::*;\nuse self::bilge;\n", [("UseCrate", "crate/helm", "steer,w", False, True), ("UseSuper", "super/deck", "*", True, False), ("UseSelf", "self", "bilge", False, False)]),
    "mast.py": ("import math, json\nfrom ..sails import jib as j\n", [("PythonImport", "math", "math", False, False), ("PythonImport", "json", "json", False, False), ("PythonFromParent", "../sails", "j", False, False)]),
    "oar.cpp": ('#include <lake/shore.h>\n#include "pier.h"\n', [("CppSystemInclude", "lake/shore.h", "", False, False), ("CppLocalInclude", "pier.h", "", False, False)]),
    "Rope.java": ("import static lake.Depths.*;\nimport lake.Ferry;\n", [("JavaStaticImport", "lake/Depths", "", True, False), ("JavaImport", "lake/Ferry", "", False, False)]),
    "cove.js": ("import bay, { isle as i } from '@lake/map';\nconst { cape } = require('./coast');\n", [("JsDefaultImport", "@lake/map", "bay,i", False, False), ("JsRequire", "./coast", "cape", False, False)]),
    "fjord.ts": ("import type Ice from './ice';\nimport 'thaw';\n", [("TsTypeDefaultImport", "./ice", "Ice", False, False), ("JsSideEffectImport", "thaw", "", False, False)]),
}


def _import_places(name: str) -> list[int]:
    """Where the statement of each of those facts begins: one a line, but the first of Python gives two."""
    code, facts = _IMPORTS[name]
    starts = [0, *(i + 1 for i, c in enumerate(code) if c == "\n")]
    return [starts[max(0, i - 1) if name.endswith(".py") else i] for i in range(len(facts))]


def language_imports(spark, sf_dir):
    """Imports of all languages in one job, a source of each for every page."""
    rows = extract.table(extract.facts(_paged(spark, sf_dir, [(k, v[0]) for k, v in _IMPORTS.items()])), "imports")
    return rows.select("file_path", "import_kind", F.array_join("path", "/").alias("path"), F.array_join("imported_names", ",").alias("names"), "is_glob", "is_reexport", "byte_start")


def language_cross_file(spark, sf_dir):
    """Names through imports of parsed sources, two for every page: local first, then explicit, then glob, aliases by their target's first symbol."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html IS NOT NULL").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("p"), _remarks(F.col("html"), "//").alias("said"))
    at = lambda name: F.concat(F.lit("/w/src/"), "p", F.lit(f"/{name}.rs"))
    boat = F.concat(F.lit("use crate::"), "p", F.lit("::pier::moor as tie;\nuse crate::"), "p", F.lit("::pier::*;\nfn moor() {}\n"), "said")
    pier = F.concat("said", F.lit("pub fn moor() {}\npub fn cast_off() {}\n"))
    files = extract.source_files(pages.select(F.inline(F.array(F.struct(at("boat").alias("file_path"), boat.alias("content")), F.struct(at("pier").alias("file_path"), pier.alias("content"))))))
    rows = written(extract.facts(files), "facts")
    modules = files.select("file_path", naming.module_path("/w", "file_path").alias("module_path"))
    imports = resolve.import_targets(extract.table(rows, "imports"), modules)
    probes = pages.select(at("boat").alias("current_file"), F.explode(F.array(*map(F.lit, ("moor", "tie", "cast_off", "sunk")))).alias("identifier"))
    return resolve.across_files(probes, extract.table(rows, "symbols"), imports)


#: Of each language: what stands before, between names, and after the functions of a made source; a function before and after its name; its length without the line end.
_MADE = [
    ("rs", "", "pub fn ", "(load: u32) -> u32 {\n    load\n}\n", 1, ""),
    ("py", "", "def ", "(load):\n    return load\n", 1, ""),
    ("c", "#include <math.h>\n", "static int ", "(int load) {\n    return load;\n}\n", 1, ""),
    ("cpp", "", "long ", "(long load, int keel) {\n    return load;\n}\n", 1, ""),
    ("java", "class Hold {\n", "    int ", "(int load) { return load; }\n", 1, "}\n"),
    ("js", "'use strict';\n", "function ", "(load, { keel }) {\n  return /[}]/.test(load);\n}\n", 1, ""),
    ("ts", "", "async function ", "(load: number): Promise<{ keel: number }> {\n  return { keel: load };\n}\n", 1, ""),
]
#: Kinds, containers, the bytes of the declaration's line before its begin, and parameters.
_MADE_FACTS = [("function", "crate::", 0, "load"), ("function", "module::", 0, "load"), ("function", "", 0, "load"), ("function", "", 0, "load,keel"), ("method", "Hold.", 4, "load"), ("function", "", 0, "load,keel"), ("function", "", 0, "load")]


def _words(text: str = "text"):
    return F.regexp_extract_all(F.col(text), F.lit("[a-z]{3,}"), F.lit(0))


def _made(spark, sf_dir) -> DataFrame:
    """A source for each document: 1 to 6 functions, in the language of its number, named by its words; its lines come first as remarks."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text", _words().alias("words"), (F.col("doc_id") % 7).cast("int").alias("which"), (F.col("doc_id") % 6).cast("int").alias("last"))
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _MADE]), F.col("which") + 1)
    said = F.when(F.col("which") == 1, _remarks(F.col("text"), "#")).otherwise(_remarks(F.col("text"), "//"))
    d = d.select("doc_id", "last", "words", said.alias("said"), pick(0).alias("ext"), pick(1).alias("head"), pick(2).alias("before"), pick(3).alias("after"), pick(5).alias("tail"))
    name = lambda k: F.concat(F.coalesce(F.get("words", k), F.lit("f")), F.lit("_"), k.cast("string"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.concat("before", name(k), "after")), "")
    return extract.source_files(d.select(F.concat(F.lit("made/"), F.col("doc_id").cast("string"), F.lit("."), F.col("ext")).alias("file_path"), F.concat("said", "head", body, "tail").alias("content")))


def _cases(column: str, values: list) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(values) -> list[str]:
    return ["'" + str(v).replace("'", "''") + "'" for v in values]


_MADE_SQL = f"""
doc AS (SELECT doc_id, (doc_id % 7)::INT AS which, regexp_extract_all(text, '[a-z]{{3,}}') AS words, CASE WHEN doc_id % 7 = 1 THEN {_size_sql(_remarks_sql("text", "#"))} ELSE {_size_sql(_remarks_sql("text"))} END AS said FROM documents WHERE text IS NOT NULL),
src AS (SELECT *, unnest(generate_series(0, doc_id % 6)) AS k FROM doc),
fn AS (SELECT doc_id, which, k, coalesce(words[k + 1], 'f') || '_' || k AS name, said + {_cases('which', [len(x[1]) for x in _MADE])} AS head, {_cases('which', [len(x[2]) for x in _MADE])} AS pre, {_cases('which', [len(x[3]) for x in _MADE])} AS post,
  {_cases('which', [x[2] for x in _MADE_FACTS])} AS indent, 'made/' || doc_id || '.' || {_cases('which', _quoted(x[0] for x in _MADE))} AS file_path FROM src),
pos AS (SELECT *, head + coalesce(sum(pre + length(name) + post) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM fn),
sym AS (SELECT *, (begin + indent)::BIGINT AS byte_start, (begin + pre + length(name) + post - 1)::BIGINT AS byte_end FROM pos)"""


def made_symbols(spark, sf_dir):
    """Functions of the made sources, all languages in one job: names, spans, parameters, visibility and node labels."""
    s = extract.table(extract.facts(_made(spark, sf_dir)), "symbols").where("kind <> 'class'")
    return s.select("file_path", "kind", "fully_qualified", "byte_start", "byte_end", F.array_join("parameters", ",").alias("parameters"), naming.kind_label("kind").alias("label"))


def made_symbols_sql(spark, sf_dir):
    """The same by SQL, with a registered table function joined laterally."""
    from lexispan.functions.tables import register

    register(spark)
    return spark.sql(
        "SELECT s.file_path, s.kind, s.fully_qualified, s.byte_start, s.byte_end, array_join(s.parameters, ',') AS parameters FROM {made} m, LATERAL source_symbols(m.file_path, m.language, m.content) s WHERE s.kind <> 'class'", made=_made(spark, sf_dir)
    )


def made_code_by_symbol(spark, sf_dir):
    """Code of a symbol by its file and name (every second function), and of a span by its place."""
    files = _made(spark, sf_dir)
    s = extract.entities(extract.table(written(extract.facts(files), "facts"), "symbols")).where("kind <> 'class'")
    chunks = written(extract.code_chunks(s, files), "chunks")
    asked = s.where("endswith(name, '_1') OR endswith(name, '_3')").select("file_path", F.col("name").alias("symbol_name"))
    told = labels.with_code(labels.chunks_of(chunks, asked).drop("content"), chunks)
    return told.select("file_path", "symbol_name", F.sha2("code", 256).alias("code_sha256"))


def made_in_file(spark, sf_dir):
    """First symbol of a file by name, any kind or the kind asked for."""
    s = extract.table(extract.facts(_made(spark, sf_dir)), "symbols")
    probes = s.where("endswith(name, '_0')").select("file_path", "name", F.explode(F.array(F.lit(None).cast("string"), F.lit("function"), F.lit("class"))).alias("kind"))
    return resolve.in_file(s, probes).select("file_path", "name", "asked_kind", "kind", "byte_start", "byte_end")


_HUB, _USERS = "/w/src/hub.rs", "pub fn beacon() { }\npub fn lamp() { beacon(); }\n"
_USES = ["use crate::hub::beacon;\nfn run() { beacon(); crate::hub::beacon(); }\n", "use crate::hub::*;\nfn run(b: Hull) { beacon(); b.beacon(); }\n", "use crate::hub::beacon;\nfn run() { fn beacon() {} beacon(); }\n", "fn run() { beacon(); }\n", "use crate::hub::beacon;\nfn run() { let beacon = 1; drop(beacon); crate::hub::beacon(); }\n"]


def texts(spark, sf_dir) -> DataFrame:
    """A text of each document's number."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


_TEXTS_SQL = "t AS (SELECT doc_id, coalesce(min(text), '') AS text FROM documents GROUP BY 1)"


def made_references(spark, sf_dir):
    """References to one function in its file and in a file per document: imported by name, by glob, shadowed, or not seen at all."""
    d = texts(spark, sf_dir)
    uses = F.element_at(F.array(*map(F.lit, _USES)), (F.col("doc_id") % len(_USES)).cast("int") + 1)
    users = d.select(F.concat(F.lit("/w/src/u"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file_path"), F.concat(_remarks(F.col("text"), "//"), uses).alias("content"))
    files = extract.source_files(users.unionByName(spark.createDataFrame([(_HUB, _USERS)], "file_path string, content string")))
    rows = written(extract.facts(files), "facts")
    t = {n: extract.table(rows, n) for n in ("identifiers", "scopes", "scope_symbols", "imports")}
    modules = files.select("file_path", naming.module_path("/w", "file_path").alias("module_path"))
    target = {"file_path": _HUB, "name": "beacon", "kind": "function", "byte_start": 0, "byte_end": len("pub fn beacon() { }"), "is_private": False}
    found = references.find(target, t["identifiers"], t["scopes"], t["scope_symbols"], t["imports"], modules)
    return found.select("file_path", "byte_start", "byte_end", F.col("context.kind").alias("context"), "origin", "by_glob")


def _reference_sql() -> str:
    def places(text: str, words: list[str], skip: int = 0) -> list[tuple[int, int]]:
        out, at = [], text.index("fn run")
        for w in words:
            at = text.index(w, at)
            out.append((at, at + len(w) - 1))
            at += len(w)
        return out[skip:]

    wanted = [(0, places(_USES[0], ["beacon(", "crate::hub::beacon("]), False), (1, places(_USES[1], ["beacon(", "beacon("]), True), (4, places(_USES[4], ["crate::hub::beacon("]), False)]
    parts = [f"SELECT '{_HUB}' AS file_path, {_USERS.index('beacon();')}::BIGINT AS byte_start, {_USERS.index('beacon();') + 6}::BIGINT AS byte_end, 'FunctionCall' AS context, 'same_file' AS origin, false AS by_glob"]
    for which, spots, glob in wanted:
        for a, b in spots:
            parts.append(f"SELECT '/w/src/u' || doc_id || '.rs', ({a} + {_size_sql(_remarks_sql('text'))})::BIGINT, ({b} + {_size_sql(_remarks_sql('text'))})::BIGINT, 'FunctionCall', 'cross_file', {str(glob).lower()} FROM t WHERE doc_id % {len(_USES)} = {which}")
    return f"WITH {_TEXTS_SQL} " + " UNION ALL ".join(parts)


def made_visibility(spark, sf_dir):
    """Visibility of items after a document's lines, and of each file those that other files can see."""
    heads = ["fn", "pub fn", "pub(crate) fn", "pub(in crate::dock) async fn"]
    d = texts(spark, sf_dir)
    code = F.concat(_remarks(F.col("text"), "//"), F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 4).cast("int") + 1), F.lit(" crane() {}\n"))
    files = extract.source_files(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file_path"), code.alias("content")))
    s = extract.table(extract.facts(files), "symbols")
    return s.select("file_path", F.col("visibility.level").alias("level"), F.col("visibility.scope").alias("scope"), (F.col("visibility.level") != "private").alias("seen_outside"), F.col("flags.is_async").alias("is_async"))


def made_pattern_replace(spark, sf_dir):
    """A literal in the lines of each document, which a source has as strings and again as remarks: replaced in the strings."""
    line = lambda x: F.concat(F.lit('  say(r##"'), x, F.lit('"##); // '), x, F.lit("\n"))
    many = F.concat(F.lit("fn f() {\n"), F.array_join(F.transform(F.split(F.replace("text", F.lit('"'), F.lit("")), "\n", -1), line), ""), F.lit("/* ing /* ing */ ing */ }\n"))
    files = extract.source_files(texts(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file_path"), many.alias("content")))
    comments = extract.table(extract.facts(files), "syntax_nodes").where("kind = 'comment'")
    return rewrite.rewritten(pattern.replacements(files, "ing", "ÏON", comments), files).select("file_path", "n_edits", F.col("after_sha256"))


def super_imports(spark, sf_dir):
    """Modules that relative paths mean: one level up, two, the module's own, and above the root."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL").select("doc_id", "source").distinct()
    modules = d.select(F.col("doc_id").alias("file_path"), F.concat_ws("::", F.lit("crate"), "source", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("module_path"))
    other = F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string"))
    path = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("super"), other)).when(F.col("doc_id") % 4 == 1, F.array(F.lit("super"), F.lit("super"), "source", other)).when(F.col("doc_id") % 4 == 2, F.array(F.lit("self"))).otherwise(F.array(*[F.lit("super")] * 3, other))
    return resolve.import_targets(d.select(F.col("doc_id").alias("file_path"), path.alias("path")), modules).select(F.col("file_path").alias("doc_id"), "target_file")


_SUPER_SQL = """WITH d AS (SELECT DISTINCT doc_id, source FROM documents WHERE source IS NOT NULL)
SELECT a.doc_id, CASE WHEN a.doc_id % 4 = 2 THEN a.doc_id WHEN a.doc_id % 4 < 2 THEN b.doc_id END AS target_file FROM d a LEFT JOIN d b ON b.source = a.source AND b.doc_id = a.doc_id + 1"""

#: What tools say, with the document's number and first words in it, and what is read from it: tool, output, line, column, message, code.
_SAID = [
    ("python", "  File \"{f}\", line {n}\n    x = = 1\n        ^\nSyntaxError: odd sign {w}", "n", "0", "'odd sign ' || w", "NULL"),
    ("python", "SyntaxError: lost {w}", "0", "0", "'lost ' || w", "NULL"),
    ("java", "{f}:{n}: error: no sail {w}\n  code\n1 error", "n", "0", "'no sail ' || w", "NULL"),
    ("javascript", "{f}:{n} (9) TypeError: no {w}", "n", "9", "'TypeError: no ' || w", "NULL"),
    ("typescript", "{f}({n},4): error TS2304: Cannot find name {w}", "n", "4", "'Cannot find name ' || w", "'TS2304'"),
    ("typescript", "  the tool {w} broke  ", "0", "0", "'the tool ' || w || ' broke'", "NULL"),
    ("c", "{f}:{n}:3: warning: slack {w}", "n", "3", "'warning: slack ' || w", "NULL"),
]


def first_words(text: str = "text"):
    """The first three words of a text, or none."""
    return F.coalesce(F.nullif(F.array_join(F.slice(_words(text), 1, 3), " "), F.lit("")), F.lit("none"))


FIRST_WORDS_SQL = "coalesce(nullif(array_to_string(regexp_extract_all(text, '[a-z]{3,}')[1:3], ' '), ''), 'none')"


def diagnostics_tools(spark, sf_dir):
    """Output of five tools about the words of a document, a run for each, and of runs that give no place; zero places are null, codes have their page."""
    d = texts(spark, sf_dir).withColumn("which", (F.col("doc_id") % len(_SAID)).cast("int"))
    n, f = F.col("doc_id").cast("string"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".x"))
    said = F.replace(F.replace(F.replace(F.element_at(F.array(*[F.lit(x[1]) for x in _SAID]), F.col("which") + 1), F.lit("{f}"), f), F.lit("{n}"), n), F.lit("{w}"), first_words())
    runs = d.select(n.alias("run_id"), f.alias("file"), said.alias("output"), F.element_at(F.array(*[F.lit(x[0]) for x in _SAID]), F.col("which") + 1).alias("tool"))
    out = None
    for tool in dict.fromkeys(x[0] for x in _SAID):
        rows = diagnostics.PARSERS[tool](runs.where(F.col("tool") == tool).drop("tool"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("run_id", "file", "level", naming.nonzero("line").alias("line"), naming.nonzero("column").alias("column"), "message", "code", naming.remediation("code").alias("remediation"))


def queries() -> dict:
    out = {f"{k}_symbols": _symbol_query(k) for k in _SYMBOLS}
    return out | {f.__name__: f for f in (language_imports, language_cross_file, made_symbols, made_symbols_sql, made_code_by_symbol, made_in_file, made_references, made_visibility, made_pattern_replace, super_imports, diagnostics_tools)}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" for v in r) + ")" for r in rows)


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, rows in _SYMBOLS.items():
        name, code = _SOURCES[k]
        placed = [(kind, path, code.index(text), code.index(text) + len(text), parameters) for kind, path, text, parameters in rows]
        mark = _MARK.get(name.rsplit(".", 1)[-1], "//")
        out[f"{k}_symbols"] = f"""WITH p AS (SELECT page_id, {_size_sql(_remarks_sql("html", mark))} AS said FROM pages WHERE html IS NOT NULL)
SELECT 'p' || page_id || '/{name}' AS file_path, kind, fully_qualified, (said + a)::BIGINT AS byte_start, (said + b)::BIGINT AS byte_end, parameters FROM p, (VALUES {_values(placed)}) t(kind, fully_qualified, a, b, parameters)"""
    facts = [(k, *fact, _import_places(k)[i], int(k.endswith(".py"))) for k, v in _IMPORTS.items() for i, fact in enumerate(v[1])]
    out["language_imports"] = f"""WITH p AS (SELECT page_id, {_size_sql(_remarks_sql("html"))} AS said, {_size_sql(_remarks_sql("html", "#"))} AS noted FROM pages WHERE html IS NOT NULL)
SELECT 'p' || page_id || '/' || name AS file_path, import_kind, path, names, is_glob, is_reexport, (a + CASE WHEN is_py = 1 THEN noted ELSE said END)::BIGINT AS byte_start FROM p, (VALUES {_values(facts)}) t(name, import_kind, path, names, is_glob, is_reexport, a, is_py)"""
    out["language_cross_file"] = """WITH p AS (SELECT '/w/src/p' || page_id || '/' AS dir FROM pages WHERE html IS NOT NULL)
SELECT dir || 'boat.rs' AS current_file, identifier, dir || file || '.rs' AS file_path, name, 'function' AS kind, priority FROM p, (VALUES ('moor', 'boat', 'moor', 0), ('tie', 'pier', 'moor', 1), ('cast_off', 'pier', 'cast_off', 2)) t(identifier, file, name, priority)"""
    kind, full, parameters = _cases("which", _quoted(x[0] for x in _MADE_FACTS)), _cases("which", _quoted(x[1] for x in _MADE_FACTS)), _cases("which", _quoted(x[3] for x in _MADE_FACTS))
    out["made_symbols"] = f"WITH {_MADE_SQL} SELECT file_path, {kind} AS kind, {full} || name AS fully_qualified, byte_start, byte_end, {parameters} AS parameters, 'symbol_' || {kind} AS label FROM sym"
    out["made_symbols_sql"] = f"WITH {_MADE_SQL} SELECT file_path, {kind} AS kind, {full} || name AS fully_qualified, byte_start, byte_end, {parameters} AS parameters FROM sym"
    text = f"{_cases('which', _quoted(x[2].lstrip() for x in _MADE))} || name || {_cases('which', _quoted(x[3][:-1] for x in _MADE))}"
    out["made_code_by_symbol"] = f"WITH {_MADE_SQL} SELECT file_path, name AS symbol_name, sha256({text}) AS code_sha256 FROM sym WHERE k IN (1, 3)"
    out["made_in_file"] = f"WITH {_MADE_SQL}, a AS (SELECT unnest([NULL, 'function']) AS asked_kind) SELECT file_path, name, asked_kind, {kind} AS kind, byte_start, byte_end FROM sym, a WHERE k = 0 AND (asked_kind IS NULL OR asked_kind = {kind})"
    out["made_references"] = _reference_sql()
    out["made_visibility"] = """SELECT DISTINCT 'd' || doc_id || '.rs' AS file_path, CASE doc_id % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'public' ELSE 'restricted' END AS level,
CASE doc_id % 4 WHEN 2 THEN 'pub(crate)' WHEN 3 THEN 'pub(in crate::dock)' END AS scope, doc_id % 4 <> 0 AS seen_outside, doc_id % 4 = 3 AS is_async FROM documents"""
    out["made_pattern_replace"] = f"""WITH {_TEXTS_SQL}, l AS (SELECT doc_id, string_split(replace(text, '"', ''), chr(10)) AS l FROM t),
n AS (SELECT doc_id, l, list_sum(list_transform(l, lambda x: len(string_split(x, 'ing')) - 1))::BIGINT AS n_edits FROM l)
SELECT 'd' || doc_id || '.rs' AS file_path, n_edits, sha256('fn f() {{' || chr(10) || array_to_string(list_transform(l, lambda x: '  say(r##"' || replace(x, 'ing', 'ÏON') || '"##); // ' || x || chr(10)), '') || '/* ing /* ing */ ing */ }}' || chr(10)) AS after_sha256 FROM n WHERE n_edits > 0"""
    out["super_imports"] = _SUPER_SQL
    told = [_cases("which", [x[k] for x in _SAID]) for k in (2, 3, 4, 5)]
    out["diagnostics_tools"] = f"""WITH {_TEXTS_SQL}, d AS (SELECT doc_id AS n, {FIRST_WORDS_SQL} AS w, 'f' || doc_id || '.x' AS file, (doc_id % {len(_SAID)})::INT AS which FROM t)
SELECT n::VARCHAR AS run_id, file, CASE WHEN which = 6 THEN 'warning' ELSE 'error' END AS level, nullif({told[0]}, 0)::BIGINT AS line, nullif({told[1]}, 0)::BIGINT AS "column", {told[2]} AS message, {told[3]} AS code,
CASE WHEN which = 4 THEN 'https://www.typescriptlang.org/errors/TS2304' END AS remediation FROM d"""
    return out
