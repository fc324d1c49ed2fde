"""Recognisers of languages against programs grown from small grammars, whose facts are known as they grow."""

import random

import pytest

from lexispan.parse.imports import imports
from lexispan.parse.lexer import Source
from lexispan.parse.scopes import identifiers, scopes
from lexispan.parse.symbols import symbols, syntax_ok

SEEDS = range(12)
SEPARATOR = {"java": "."}
ROOT = {"rust": "crate::", "python": "module::"}


class Grower:
    """Writes a program and notes what it declares: (kind, path)."""

    def __init__(self, seed: int, language: str):
        self.rng, self.language, self.n, self.want = random.Random(f"{language}{seed}"), language, 0, []

    def name(self, upper: bool = False) -> str:
        self.n += 1
        word = self.rng.choice(["zephyr", "quartz", "n_9", "sedge"])
        return f"{word.capitalize() if upper else word}{self.n}"

    def note(self, kind: str, path: list[str]) -> None:
        self.want.append((kind, ROOT.get(self.language, "") + SEPARATOR.get(self.language, "::").join(path)))

    def several(self, most: int, make) -> list:
        return [make() for _ in range(self.rng.randint(1, most))]

    def noise(self, line: str, block: tuple[str, str] | None, string: str) -> str:
        """What looks like a declaration and is none."""
        self.n += 1
        return self.rng.choice([f"{line} fn def class function {self.n}() {{\n", *([f"{block[0]} class fake {{ void x() {block[1]}\n"] if block else []), f"{string}\n"])


def rust(g: Grower, path: list[str], deep: int) -> str:
    def function():
        name = g.name()
        g.note("function", [*path, name])
        head = g.rng.choice(["", "pub ", "pub(super) ", "const ", 'pub unsafe extern "C" ', "#[inline(always)]\nasync "])
        return f"{head}fn {name}<'a, const N: usize>(q: [u8; N], r: &'a dyn Fn(u8) -> u8) -> impl Iterator<Item = u8> + 'a where u8: Copy {{ let s = '}}'; loop {{ break }} }}\n"

    def raw():
        name = g.rng.choice(["try", "match", "dyn"])
        g.note("function", [*path, name])
        return f"pub fn r#{name}(r#type: u8) {{ r#{name}(r#type) }}\n"

    def kept(kind, text):
        name = g.name(True)
        g.note(kind, [*path, name])
        return text.format(n=name)

    def implementation():
        name = g.name(True)
        g.note("impl", [*path, name])
        head = g.rng.choice(["impl {n}", "impl<T> From<T> for {n}", "unsafe impl<'b, T: ?Sized> a::b::Send for x::{n}<'b, T>"]).format(n=name)
        return head + " {\n" + "".join(g.several(2, function)) + "}\n"

    def module():
        name = g.name()
        g.note("module", [*path, name])
        return f"pub mod {name} {{\n{rust(g, [*path, name], deep - 1)}}}\n" if deep else f"mod {name} {{}}\n"

    options = [
        function, implementation, module, lambda: kept("struct", "struct {n}(u8, Vec<(u8, u8)>);\n"), lambda: kept("struct", "pub struct {n}<T> where T: Ord {{ a: T, b: [u8; 3] }}\n"),
        lambda: kept("enum", "enum {n} {{ Up(u8), Down {{ by: i64 }}, Flat = 7 }}\n"), lambda: kept("trait", "pub trait {n}: Sized {{ const K: u8; type O; }}\n"),
        lambda: g.noise("//", ("/* /* fn no() {} */", "*/"), 'static S: &str = r#"fn " in() {}"#;'), lambda: "macro_rules! heap { ($a:ty) => { fn hidden() -> $a { 1 } struct Unseen; } }\n", raw,
    ]
    return "".join(g.rng.choice(options)() for _ in range(g.rng.randint(2, 6)))


def python(g: Grower, path: list[str], deep: int, pad: str = "") -> str:
    def function():
        name = g.name()
        g.note("function", [*path, name])
        head = g.rng.choice(["def ", "async def ", f"@wrap(a, b=[1,\n  2])\n{pad}def "])
        body = python(g, [*path, name], deep - 1, pad + "    ") if deep and g.rng.random() < 0.4 else f"{pad}    return {{'def no(): pass': [1, 2]}}\n"
        return f"{pad}{head}{name}(self, x=(1, 2), *, y: 'dict[str, int]' = None) -> int:\n{body}"

    def kind():
        name = g.name(True)
        g.note("class", [*path, name])
        body = python(g, [*path, name], deep - 1, pad + "    ") if deep else f"{pad}    pass\n"
        return f"{pad}class {name}(Base, metaclass=Meta):\n{body}"

    other = [f'{pad}"""def a():\nclass B: pass\n"""\n', f"{pad}# class C:\n{pad}z = lambda def_: 0\n", f"{pad}if x:\n{pad}    w = 1\n"]
    return "".join(g.several(3, lambda: g.rng.choice([function, kind])())) + g.rng.choice(other)


def cpp(g: Grower, path: list[str], deep: int) -> str:
    free = "method" if path and path[-1][0].isupper() else "function"

    def function():
        name = g.name()
        g.note(free, [*path, name])
        return f"static std::map<int, Box<Box<int>>> {name}(const Box<int>& a, int (*b)(int, char), char c = '{{') noexcept {{ auto f = [&](int q) {{ return q; }}; return {{}}; }}\n"

    def holder(kind, head):
        name = g.name(True)
        g.note(kind, [*path, name])
        inside = cpp(g, [*path, name], deep - 1) if deep else "int z;\n"
        return f"{head} {name} final : public virtual Base<int>, private Other {{\npublic:\n{inside}}};\n"

    def space():
        name = g.name()
        g.note("namespace", [*path, name])
        return f"namespace {name} {{\n{cpp(g, [*path, name], deep - 1)}}}\n"

    options = [function, lambda: holder("class", "class"), lambda: holder("struct", "struct [[nodiscard]]"), lambda: g.noise("//", ("/* ", "*/"), 'auto t = R"(int no() { })";'), lambda: g.noise("//", None, "#define Q(a) int no() { return a; }")]
    return "".join(g.rng.choice(options + ([space] if free == "function" and deep else []))() for _ in range(g.rng.randint(2, 4)))


def java(g: Grower, path: list[str], deep: int) -> str:
    def kind():
        word, name = g.rng.choice(["class", "interface", "enum"]), g.name(True)
        own = [*path, name]
        g.note(word, own)
        out = [f"@Deprecated(since = \"class A {{\") {g.rng.choice(['public ', ''])}{word} {name}{'<T extends Comparable<? super T>>' if word != 'enum' else ''} {{\n"]
        out += ["  ONE, TWO;\n"] * (word == "enum")
        if word != "interface":
            field = g.name()
            g.note("field", [*own, field])
            g.note("constructor", [*own, name])
            out.append(f"  private static final Map<String, int[]> {field} = make(1, '{{'), {field}b = null;\n  {name}(int... a) {{ this(a, 2); }}\n")
        method = g.name()
        g.note("method", [*own, method])
        out.append(f"  <R> R {method}(final List<? extends R> in) throws A, B" + (";\n" if word == "interface" else " { return make(in -> { return in; }); }\n"))
        return "".join(out) + (java(g, own, deep - 1) if deep else "") + "}\n"

    return "".join(g.several(2, kind)) + g.noise("//", ("/* ", "*/"), "")


def script(g: Grower, path: list[str], deep: int) -> str:
    typed = g.language == "typescript"

    def function():
        name = g.name()
        g.note("function", [*path, name])
        sign = "(a: { b: [number, string] }, ...c: unknown[]): asserts a is any" if typed else "({ a = 1, b: [c] }, ...d)"
        return f"{g.rng.choice(['', 'async ', 'export ', 'export default '])}function {name}{sign} {{ return `${{'function no() {{'}}`; }}\n"

    def kind():
        name = g.name(True)
        g.note("class", [*path, name])
        methods = []
        for _ in range(g.rng.randint(1, 3)):
            m = g.name()
            g.note("method", [*path, name, m])
            methods.append(f"  {g.rng.choice(['', 'static ', 'async '])}{m}(x) {{ if (x) {{ return /[}}(]/.test(x); }} }}\n")
        return f"{g.rng.choice(['', 'export '])}class {name} extends mix(A, B) {{\n{''.join(methods)}}}\n"

    def variable():
        name = g.name()
        g.note("variable", [*path, name])
        value = g.rng.choice(["{ class: 1, f() { return 2; } }", "[1, /}/g]", "(x) => ({ y: x })", "`a${`b${1}`}c`"])
        return f"{g.rng.choice(['const', 'let', 'var'])} {name} = {value};\n"

    def of_types():
        word, name = g.rng.choice(["interface", "type_alias", "enum", "namespace"]), g.name(True)
        g.note(word, [*path, name])
        if word == "namespace":
            return f"namespace {name} {{\n{script(g, [*path, name], 0)}}}\n"
        return {"interface": f"export interface {name}<T = {{}}> extends A<T>, B {{ f(x: T): void; readonly [k: string]: unknown }}\n", "type_alias": f"type {name}<K> = K extends `${{infer R}}` ? {{ [P in R]: () => void }} : never;\n", "enum": f"const enum {name} {{ A = 1 << 2, B = 'class' }}\n"}[word]

    options = [function, kind, variable, lambda: g.noise("//", ("/* ", "*/"), "'class no { }';")] + ([of_types] if typed and deep else [])
    return "".join(g.rng.choice(options)() for _ in range(g.rng.randint(2, 6)))


GROW = {"rust": rust, "python": python, "cpp": cpp, "java": java, "javascript": script, "typescript": script}


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("language", GROW)
def test_symbols_of_grown_programs(language, seed):
    g = Grower(seed, language)
    code = GROW[language](g, [], 2)
    data, found = code.encode(), symbols(code.encode(), language)
    assert [(s["kind"], s["fully_qualified"]) for s in found] == g.want, code
    for s in found:
        own, before = data[s["byte_start"] : s["byte_end"]], data[: s["byte_start"]]
        assert s["name"].encode() in own
        assert (s["line_start"], s["col_start"]) == (before.count(b"\n") + 1, len(before) - before.rfind(b"\n") - 1)
        assert s["line_end"] == s["line_start"] + own.count(b"\n")
        inside = [x for x in found if x["fully_qualified"].startswith(s["fully_qualified"] + SEPARATOR.get(language, "::")) and s["kind"] != "impl"]
        assert all(s["byte_start"] <= x["byte_start"] and x["byte_end"] <= s["byte_end"] for x in inside)
    assert syntax_ok(data, language), code


def test_members_carry_their_modifiers():
    """One source a language in which each modifier occurs with and without its neighbours."""
    rows = {s["name"]: s for s in symbols("mod coast { pub(in crate::coast) const unsafe fn ebb(ref mut pull: Moon, (lo, hi): (u8, u8), _: ()) {} async fn flow<F>(self: Box<Self>, f: F) {} pub trait Wave {} }".encode(), "rust")}
    assert {n: (r["visibility"]["level"], r["visibility"]["scope"], r["flags"]["is_async"], r["parameters"]) for n, r in rows.items()} == {
        "coast": ("private", None, False, []), "ebb": ("restricted", "pub(in crate::coast)", False, ["pull", "lo", "_"]), "flow": ("private", None, True, ["f"]), "Wave": ("public", None, False, []),
    }
    rows = {s["name"]: s for s in symbols(b"class Reed:\n    async def bend(self, /, by, *rest, why=None, **more): pass\n    def stand(cls): pass\n", "python")}
    assert (rows["bend"]["flags"]["is_async"], rows["bend"]["parameters"], rows["stand"]["flags"]["is_async"]) == (True, ["by", "rest", "why", "more"], False)
    rows = {s["name"]: s for s in symbols(b"abstract class Moor { public static final <T> T peat(T[] a, Map<T, ? super T>... b) { return null; } protected abstract void fen(); public int bog; }", "java")}
    assert {n: (r["flags"]["is_public"], r["flags"]["is_static"], r["parameters"]) for n, r in rows.items()} == {"Moor": (False, False, []), "peat": (True, True, ["a", "b"]), "fen": (False, False, []), "bog": (True, False, [])}
    rows = {s["name"]: s for s in symbols(b"export async function sand(a, { b }, [c] = [], ...d) {}\nfunction silt() {}\nexport class Loam {}", "typescript")}
    assert {n: (r["flags"]["is_async"], r["flags"]["is_exported"]) for n, r in rows.items()} == {"sand": (True, True), "silt": (False, False), "Loam": (False, True)}
    (s,) = symbols("/* ø */ template <class T> auto dune(T&& wind, std::vector<std::pair<T, int>> grains) { return wind; }".encode(), "cpp")
    assert (s["kind"], s["parameters"], s["byte_start"], s["flags"]["is_template"]) == ("template_function", ["wind", "grains"], 9, True)


def imported(g: Grower) -> tuple[str, list]:
    """One statement and the facts (kind, path, names, is_glob) that it gives."""
    a, b, c, d = (g.name() for _ in range(4))
    pick = g.rng.choice
    if g.language == "rust":
        top, kind = pick([("crate", "UseCrate"), ("super", "UseSuper"), ("self", "UseSelf"), (a, "PlainUse")])
        head = pick(["", "pub ", "pub(crate) ", "#[cfg(test)]\n"])
        form = pick(["name", "star", "list", "alias", "deep"])
        tail, facts = {
            "name": (f"{b}::{c}", [(kind, [top, b], [c], False)]), "star": (f"{b}::{c}::*", [(kind, [top, b, c], ["*"], True)]), "list": (f"{b}::{{ {c}, {d} as r#{a}x, }}", [(kind, [top, b], [c, f"{a}x"], False)]),
            "alias": (f"{b} as {d}", [(kind, [top], [d], False)]), "deep": (f"{{{b}::{{{c}, self}}, {d}}}", [(kind, [top], [d], False), (kind, [top, b], [c, "self"], False)]),
        }[form]
        return f"{head}use {top}::{tail};\n", facts
    if g.language == "python":
        dots, kind = pick([("", "PythonFrom"), (".", "PythonFromRelative"), ("..", "PythonFromParent"), ("....", "PythonFromAncestor")])
        where, path = pick([(a, [a]), (f"{a}.{b}", [a, b])])
        form = pick(["plain", "many", "star", "wrapped"])
        if form == "plain":
            return f"import {a}.{b}.{c} as {d}, {c}\n", [("PythonImport", [a, b, c], [d], False), ("PythonImport", [c], [c], False)]
        names = {"many": (f"{c}, {d} as {a}z", [c, f"{a}z"]), "star": ("*", ["*"]), "wrapped": (f"(  # {b}\n    {c},\n    {d},\n)", [c, d])}[form]
        return f"from {dots}{where} import {names[0]}\n", [(kind, ([dots] if dots else []) + path, names[1], form == "star")]
    if g.language in ("c", "cpp"):
        return pick([(f"  #  include <{a}/{b}.hpp> // {c}\n", [("CppSystemInclude", [a, f"{b}.hpp"], [], False)]), (f'#include "../{a}/{c}.inl"\n', [("CppLocalInclude", ["..", a, f"{c}.inl"], [], False)])])
    if g.language == "java":
        still, kind = pick([("static ", "JavaStaticImport"), ("", "JavaImport")])
        return pick([(f"import {still}{a}.{b}.{c}.*;\n", [(kind, [a, b, c], [], True)]), (f"import {still}{a}.{b}.{d};\n", [(kind, [a, b, d], [], False)])])
    where, path = pick([(f"../{a}/{b}", ["..", a, b]), (f"@{a}/{b}/{c}", [f"@{a}", b, c])])
    forms = [
        (f"import {{ {c}, {d} as {b}y }} from '{where}';\n", [("JsImport", path, [c, f"{b}y"], False)]), (f'import * as {d} from "{where}"\n', [("JsNamespaceImport", path, [d], True)]), (f"import '{where}';\n", [("JsSideEffectImport", path, [], False)]),
        (f"import {d} from '{where}';\n", [("JsDefaultImport", path, [d], False)]),
    ]
    if g.language == "typescript":
        forms += [(f"import type {{ {c}, {d} }} from '{where}';\n", [("TsTypeImport", path, [c, d], False)]), (f"import type {c} from '{where}';\n", [("TsTypeDefaultImport", path, [c], False)]), (f"import {{ type {c}, {d} }} from '{where}';\n", [("JsImport", path, [c, d], False)])]
    else:
        forms.append((f"let {d} = require('{where}');\n", [("JsRequire", path, [d], False)]))
    return pick(forms)


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("language", ["rust", "python", "c", "cpp", "java", "javascript", "typescript"])
def test_imports_of_grown_programs(language, seed):
    g = Grower(seed, language)
    out, want = [], []
    for _ in range(6):
        code, facts = imported(g)
        at = len("".join(out).encode()) + len(code) - len(code.lstrip())
        want += [(*f, at if not code.startswith("#[") else None) for f in facts]
        out.append(code)
        out += [{"python": "# import no\n'from no import no'\n"}.get(language, "/* import no; */ // use no::no;\n")]
    data = "".join(out).encode()
    found = imports(data, language)
    assert sorted((f["import_kind"], f["path"], f["imported_names"], f["is_glob"]) for f in found) == sorted(w[:4] for w in want), data.decode()
    starts = {(f["import_kind"], *f["path"], *f["imported_names"]): f["byte_start"] for f in found}
    for kind, path, names, _, at in want:
        assert at is None or data[: starts[kind, *path, *names]].count(b"\n") == data[:at].count(b"\n")


def test_reexports_need_a_visibility():
    data = b"use a::b;\npub use c::d;\npub(in crate::e) use f::*;\nfn g() { use h::i; }\n"
    assert [(f["path"], f["is_reexport"]) for f in imports(data, "rust")] == [(["a"], False), (["c"], True), (["f"], True), (["h"], False)]


def test_a_name_holds_from_its_declaration_on():
    """Closures, matches, loops and blocks: every use is inside a scope that declares its name, or is free."""
    code = b"fn helm(course: u8) { wind(course); let sea = |swell: u8| swell + course; match sea { Calm(depth) if depth > 2 => depth, other => other }; { let keel = 1; keel } }"
    rows, declared = scopes(Source(code, "rust"))
    where = {r["scope_id"]: (r["byte_start"], r["byte_end"]) for r in rows}
    held = {}
    for d in declared:
        held.setdefault(d["name"], []).append((max(d["declaration_pos"], where[d["scope_id"]][0]), where[d["scope_id"]][1]))
    assert {"helm", "course", "sea", "swell", "depth", "other", "keel"} <= set(held) and "wind" not in held
    for use in identifiers(Source(code, "rust")):
        if use["name"] in ("swell", "depth", "keel", "other", "sea"):
            assert any(a <= use["byte_start"] < b for a, b in held[use["name"]]), use


def test_scopes_of_long_headers():
    names = [f"leg{i}" for i in range(60)]
    code = f"fn plan() {{ for ({', '.join(names)}) in legs {{ let last = leg9; }} for Mark {{ lat, lon }} in marks {{ lat; }} }}".encode()
    rows, declared = scopes(Source(code, "rust"))
    inside = {d["name"]: d["scope_id"] for d in declared}
    assert {*names, "last", "lon"} <= set(inside) and inside["leg0"] == inside["last"] != inside["plan"]
    assert [r["parent_id"] for r in rows][:3] == [None, 0, 1]


@pytest.mark.parametrize(
    ("language", "code", "ok"),
    [
        ("rust", "fn f() { (1) }", True), ("rust", "fn f() { (1 }", False), ("rust", "fn f() { let = = ; }", False), ("rust", "fn f() { row boat }", False), ("rust", "fn f() -> { 1 }", False), ("rust", "struct fn { }", False),
        ("rust", "fn f<T: A + B>(x: &T) -> Vec<u8> where T: C { let mut a = vec![1 2]; a += 1; if a == b { return a; } m!(= ; x y); let S { x, .. } = s; let r = 0..=5; match x { A => 1, _ => 2 } }", True),
        ("rust", "#[cfg(odd words)] union U { a: u8 }\nmacro_rules! q { ($a:expr) => { = ; } }\ntype F = dyn Fn(u8) -> u8;", True),
        ("python", "def f(): pass", True), ("python", "def f(:", False),
        ("java", "class class { int int; }", False), ("java", "interface { }", False), ("java", "class A { int f() { return 4 } }", False), ("java", "class A { int[] a = {1}; void f(List<? extends B> x) { a = b == c ? d : e; i++; } Class<?> c = A.class; }", True),
        ("c", "int f(void) { return 4 }", False), ("c", "int f() { int x = ; }", False), ("c", "int f(void) { int a[] = {1, 2}; return (struct P){1, 2}.x; }\n#define Q(a) a +\nAPPLY(+, =)\nunsigned long long b;", True),
        ("cpp", "class class { };", False), ("cpp", "X& operator=(const X&) = default; auto l = [=](int a) { return a; }; struct { int a; } b; enum class E { A }; friend class C; template <class T = int> class Q;", True),
        ("javascript", "let = 5;", False), ("javascript", "const r = /[(]?(?=;)+\\(/g; let q = a / b / c; let { c, d = 1 } = e; x = class { m() {} }; y = class extends Z {}; if (a === b) { a ||= 2 }", True),
        ("typescript", "interface { a: string }", False), ("typescript", "type A = { class: string; let: number }; enum B { X = 1 } const enum C { Y }", True),
        ("prose", "anything (", True),
    ],
)
def test_syntax(language, code, ok):
    assert syntax_ok(code.encode(), language) == ok


def test_syntax_needs_utf8():
    assert not syntax_ok(b"\xff", "java")
