"""Import facts of a source: kind, path, names, whether all is taken, whether it is passed on, and its span."""

from __future__ import annotations

import re

from lexispan.parse.lexer import Source, decoded


def _fact(kind: str, path: list[str], names: list[str], start: int, end: int, glob: bool = False, reexport: bool = False) -> dict:
    return {"import_kind": kind, "path": path, "imported_names": names, "is_glob": glob, "is_reexport": reexport, "byte_start": start, "byte_end": end}


_RUST_KINDS = {"crate": "UseCrate", "super": "UseSuper", "self": "UseSelf"}


def rust(src: Source) -> list[dict]:
    """One fact for each use and each list of plain names in it; an alias stands for its name."""
    from lexispan.parse.symbols import rust_start

    out = []

    def tree(i: int, last: int, path: list[str]) -> None:
        groups = [[]]
        k = i
        while k < last:
            if src.text(k) == ",":
                groups.append([])
            else:
                groups[-1].append(k)
                if src.text(k) == "{":
                    groups[-1].extend(range(k + 1, src.close[k] + 1))
                    k = src.close[k]
            k += 1
        names, later, glob = [], [], False
        for g in (g for g in groups if g):
            brace = next((k for k in g if src.text(k) == "{"), None)
            parts = [src.name(k) for k in g if src.is_name(k) and (brace is None or k < brace)]
            if brace is not None:
                later.append((brace + 1, src.close[brace], path + parts))
                continue
            if "as" in parts:
                parts = [*parts[: parts.index("as") - 1], parts[-1]]
            elif src.text(g[-1]) == "*":
                parts.append("*")
            if len(parts) == 1:
                names.append(parts[0])
                glob |= parts[0] == "*"
            elif parts:
                later.append((parts[:-1], parts[-1]))
        if names:
            found.append((path or [n for n in names[:1] if n != "*"], names, glob))
        for x in later:
            if len(x) == 3:
                tree(*x)
            else:
                found.append((path + x[0], [x[1]], x[1] == "*"))

    for i, t in enumerate(src.tokens):
        if t.text != "use" or t.kind != "name" or src.text(i - 1) in (".", "::"):
            continue
        last = src.until(i, ";")
        first, visibility, _ = rust_start(src, i)
        found: list = []
        tree(i + 1, last, [])
        for path, names, glob in found:
            out.append(_fact(_RUST_KINDS.get(path[0] if path else "", "PlainUse"), path, names, src.tokens[first].start, src.end(last), glob, visibility[0] != "private"))
    return out


_PY_DOTS = {1: "PythonFromRelative", 2: "PythonFromParent"}


def python(src: Source) -> list[dict]:
    out = []
    text, lines = src.tokens, src.place
    for i, t in enumerate(text):
        opens = i == 0 or lines(text[i - 1].end - 1)[0] < lines(t.start)[0] or src.text(i - 1) in (";", ":")
        if t.kind != "name" or t.text not in ("import", "from") or not opens:
            continue
        last, k = i, i
        while k < len(text) and src.text(k) != ";" and lines(text[k].start)[0] <= lines(text[last].end - 1)[0]:
            last = min(src.close.get(k, k), len(text) - 1)
            k = last + 1
        span = (t.start, text[last].end)
        if t.text == "import":
            group: list[list[str]] = [[]]
            for k in range(i + 1, last + 1):
                if src.text(k) == ",":
                    group.append([])
                elif src.is_name(k):
                    group[-1].append(src.name(k))
            for g in (g for g in group if g):
                path, alias = (g[: g.index("as")], g[-1]) if "as" in g else (g, g[0])
                out.append(_fact("PythonImport", path, [alias], *span))
            continue
        at = next((k for k in range(i + 1, last + 1) if src.text(k) == "import"), None)
        if at is None:
            continue
        dots = sum(len(src.text(k)) for k in range(i + 1, at) if set(src.text(k)) == {"."} and (k - 1 == i or not src.is_name(k - 1)))
        path = (["." * dots] if dots else []) + [src.name(k) for k in range(i + 1, at) if src.is_name(k)]
        names, own = [], []
        for k in range(at + 1, last + 2):
            if k > last or src.text(k) == ",":
                if own:
                    names.append(own[-1])
                own = []
            elif src.is_name(k) or src.text(k) == "*":
                own.append(src.name(k))
        out.append(_fact(_PY_DOTS.get(dots, "PythonFromAncestor") if dots else "PythonFrom", path, names, *span, "*" in names))
    return out


_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*(<([^>\n]*)>|"([^"\n]*)")', re.MULTILINE)


def cpp(src: Source) -> list[dict]:
    out = []
    for m in _INCLUDE.finditer(src.data.decode("latin-1")):
        if any(a <= m.start() < b for a, b in src.comments):
            continue
        system, path = m[2] is not None, decoded(m[2] if m[2] is not None else m[3]).split("/")
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        out.append(_fact("CppSystemInclude" if system else "CppLocalInclude", path, [], start, m.end()))
    return out


def java(src: Source) -> list[dict]:
    out = []
    for i, t in enumerate(src.tokens):
        if t.kind == "name" and t.text == "import" and src.text(i - 1) in ("", ";", "}"):
            last = src.until(i, ";")
            static = src.text(i + 1) == "static"
            path = [src.name(k) for k in range(i + 1 + static, last) if src.is_name(k)]
            out.append(_fact("JavaStaticImport" if static else "JavaImport", path, [], t.start, src.end(last), src.text(last - 1) == "*"))
    return out


def _module(text: str) -> list[str]:
    return [p for p in decoded(text[1:-1]).split("/") if p]


def ecma(src: Source) -> list[dict]:
    typed = src.language == "typescript"
    out = []
    for i, t in enumerate(src.tokens):
        if t.kind != "name":
            continue
        if t.text == "require" and src.text(i + 1) == "(" and i + 2 < len(src.tokens) and src.tokens[i + 2].kind == "str" and src.text(i - 1) == "=":
            first = i - 2
            if src.text(i - 2) == "}":
                first = next((o for o, c in src.close.items() if c == i - 2), i - 2)
            names = [src.name(k) for k in range(first, i - 1) if src.is_name(k)]
            begin = first - 1 if src.text(first - 1) in ("const", "let", "var") else first
            end = src.close[i + 1]
            out.append(_fact("JsRequire", _module(src.text(i + 2)), names, src.tokens[begin].start, src.end(end + 1 if src.text(end + 1) == ";" else end)))
            continue
        passed = t.text == "export" and src.text(i + 1) in ("{", "*")
        if not passed and (t.text != "import" or src.text(i + 1) in ("(", ".") or src.text(i - 1) == "."):
            continue
        k = i + 1
        while k < len(src.tokens) and src.tokens[k].kind != "str" and src.text(k) not in (";", "import", "export"):
            k = src.close[k] + 1 if k in src.close else k + 1
        if k >= len(src.tokens) or src.tokens[k].kind != "str":
            continue
        only_type = typed and src.text(i + 1) == "type" and src.text(i + 2) not in ("from", ",")
        names, kind, glob, at = [], "JsSideEffectImport", False, i + 1 + only_type
        if src.is_name(at) and not passed:
            names.append(src.name(at))
            kind = "TsTypeDefaultImport" if only_type else "JsDefaultImport"
            at += 2 if src.text(at + 1) == "," else 1
        if src.text(at) == "*":
            glob, kind = True, kind if names else "JsNamespaceImport"
            if src.text(at + 1) == "as":
                names.append(src.name(at + 2))
        elif src.text(at) == "{":
            kind = kind if names else "TsTypeImport" if only_type else "JsImport"
            own: list[str] = []
            for j in range(at + 1, src.close[at] + 1):
                if src.text(j) in (",", "}"):
                    if own:
                        names.append(own[-1])
                    own = []
                elif src.is_name(j):
                    own.append(src.name(j))
        end = k + 1 if src.text(k + 1) == ";" else k
        out.append(_fact(kind, _module(src.text(k)), names, t.start, src.end(end), glob, passed))
    return out


EXTRACTORS = {"rust": rust, "python": python, "c": cpp, "cpp": cpp, "java": java, "javascript": ecma, "typescript": ecma}


def imports(data: bytes, language: str) -> list[dict]:
    extract = EXTRACTORS.get(language)
    return extract(Source(data, language)) if extract else []
