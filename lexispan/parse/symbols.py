"""Declarations of a source, in order, outer before inner."""

from __future__ import annotations

from lexispan.parse.grammar import broken
from lexispan.parse.lexer import Source, parameter_groups

_FLAGS = ("is_async", "is_exported", "is_public", "is_static", "is_template")


def _symbol(src: Source, name: str, kind: str, first: int, last: int, container: str, sep: str, parameters=(), visibility=("private", None), start: int | None = None, **flags) -> dict:
    """The declaration of tokens first to last; ``start`` moves its beginning."""
    a, b = src.tokens[first].start if start is None else start, src.end(last)
    (line_a, col_a), (line_b, col_b) = src.place(a), src.place(b)
    return {
        "name": name, "kind": kind, "byte_start": a, "byte_end": b, "line_start": line_a, "line_end": line_b, "col_start": col_a, "col_end": col_b,
        "container_path": container, "fully_qualified": f"{container}{sep}{name}" if container else name, "parameters": list(parameters),
        "visibility": {"level": visibility[0], "scope": visibility[1]}, "flags": {f: bool(flags.get(f)) for f in _FLAGS},
    }


# Rust

_RUST_ITEMS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module"}


def rust_start(src: Source, i: int) -> tuple[int, tuple[str, str | None], bool]:
    """Where an item with its keyword at i begins, its visibility, and whether it is async."""
    first, is_async = i, False
    while first:
        t = src.tokens[first - 1]
        if t.text in ("async", "const", "unsafe", "default", "extern") or (t.kind == "str" and src.text(first - 2) == "extern"):
            is_async |= t.text == "async"
            first -= 1
        else:
            break
    if src.text(first - 1) == "pub":
        return first - 1, ("public", None), is_async
    if src.text(first - 1) == ")":
        opening = src.opened.get(first - 1)
        if opening and src.text(opening - 1) == "pub":
            scope = src.data[src.tokens[opening - 1].start : src.tokens[first - 1].end].decode("utf-8", "replace")
            return opening - 1, ("restricted", scope), is_async
    return first, ("private", None), is_async


def _rust_type_name(src: Source, i: int, last: int) -> str:
    """Last part of the type that an impl is for."""
    depth, name = 0, ""
    while i < last:
        t = src.tokens[i]
        if t.text == "where" and depth == 0:
            break
        if t.text == "for" and depth == 0:
            name = ""
        elif t.text in "<>" and t.kind == "op":
            depth += 1 if t.text == "<" else -1
        elif t.kind == "name" and depth == 0 and t.text not in ("mut", "dyn", "unsafe", "const"):
            name = src.name(i)
        i += 1
    return name


def rust(src: Source) -> list[dict]:
    out, inside, past = [], [], 0  # (end of a module's tokens, its path); end of a macro's patterns and templates
    for i, t in enumerate(src.tokens):
        if t.text == "macro_rules" and src.text(i + 1) == "!":
            past = max(past, src.close.get(i + 3, i))
        if i < past:
            continue
        while inside and i >= inside[-1][0]:
            inside.pop()
        container = inside[-1][1] if inside else "crate"
        kind = _RUST_ITEMS.get(t.text) if t.kind == "name" else None
        if not kind or (kind != "impl" and not src.is_name(i + 1)) or src.text(i - 1) in (".", "::", "->", ":", "<", "(", ",", "&", "="):
            continue
        body = src.until(i + 1, "{;")
        if body >= len(src.tokens) and kind != "impl":
            continue
        last = src.close[body] if src.text(body) == "{" else body
        if kind == "function" and src.text(body) != "{":
            continue  # a signature in a trait or an extern block defines nothing
        first, visibility, is_async = rust_start(src, i)
        name = _rust_type_name(src, i + 1, body) if kind == "impl" else src.name(i + 1)
        parameters = []
        if kind == "function":
            opening = src.until(i + 1, "(", body)
            for g in parameter_groups(src, opening) if opening < body else ():
                names = [src.name(k) for k in g if src.is_name(k) and src.text(k) not in ("mut", "ref")]
                if names and "self" not in names[:1]:
                    parameters.append(names[0])
        out.append(_symbol(src, name, kind, first, last, container, "::", parameters, visibility, is_async=is_async))
        if kind == "module" and src.text(body) == "{":
            inside.append((last, f"{container}::{name}"))
    return out


# Python


def python_blocks(src: Source):
    """(keyword's token index, byte column, end offset of the block) of each def and class."""
    data, tokens = src.data, src.tokens
    line_first: dict[int, int] = {}  # line: its first token
    inner = set()
    for o, c in src.close.items():
        inner.update(range(o + 1, c))
    for i, t in enumerate(tokens):
        line = src.place(t.start)[0]
        if line not in line_first and i not in inner and t.text not in ")]}":
            line_first[line] = i
    starts = sorted(line_first.items())
    for n, (line, i) in enumerate(starts):
        k = i + 1 if tokens[i].text == "async" else i
        if src.text(k) not in ("def", "class") or not src.is_name(k + 1):
            continue
        column = src.place(tokens[i].start)[1]
        head = src.place(src.end(src.until(k, ":")) - 1)[0]  # the line on which the block opens
        after = next((j for ln, j in starts[n + 1 :] if ln > max(line, head - 1) and src.place(tokens[j].start)[1] <= column), None)
        end = tokens[after - 1].end if after else len(data.rstrip())
        if after is None and tokens:
            end = tokens[-1].end
        yield i, k, column, end


def python(src: Source) -> list[dict]:
    out, inside = [], []  # (column, path)
    for first, k, column, end in python_blocks(src):
        while inside and inside[-1][0] >= column:
            inside.pop()
        container = inside[-1][1] if inside else "module"
        name, is_def = src.name(k + 1), src.text(k) == "def"
        parameters = []
        if is_def:
            opening = src.until(k + 2, "(")
            for g in parameter_groups(src, opening) if opening < len(src.tokens) else ():
                names = [src.name(j) for j in g if src.is_name(j)]
                if names and names[0] != "self":
                    parameters.append(names[0])
        s = _symbol(src, name, "function" if is_def else "class", first, first, container, "::", parameters, ("public", None), is_async=src.text(first) == "async")
        s["byte_end"] = end
        s["line_end"], s["col_end"] = src.place(end)
        out.append(s)
        inside.append((column, f"{container}::{name}"))
    return out


# C and C++

_C_WORDS = {"if", "for", "while", "switch", "return", "else", "do", "sizeof", "catch", "new", "delete", "throw", "case", "goto", "operator", "alignof", "decltype", "static_assert", "defined", "using", "typedef"}


def _c_parameters(src: Source, opening: int) -> list[str]:
    out = []
    for g in parameter_groups(src, opening):
        cut = next((n for n, k in enumerate(g) if src.text(k) in ("=", "[")), len(g))
        names = [k for k in g[:cut] if src.is_name(k)]
        if len(names) > 1 or (names and any(src.text(k) in "*&" for k in g[:cut]) and names[-1] != g[0]):
            out.append(src.name(names[-1]))
    return out


_C_ATTRIBUTES = ("__attribute__", "__declspec", "alignas", "_Alignas", "__asm__")


def cpp(src: Source) -> list[dict]:
    out: list[dict] = []

    def attributes_end(k: int) -> int:
        """Past attributes that begin at a token."""
        while True:
            if src.text(k) in _C_ATTRIBUTES and src.text(k + 1) == "(":
                k = src.close[k + 1] + 1
            elif src.text(k) == "[" and src.text(k + 1) == "[":
                k = src.close[k] + 1
            else:
                return k

    def keyword(i: int, stop: int) -> int | None:
        """The word that begins a type or namespace, behind whatever specifiers and attributes a header begins with."""
        k = attributes_end(i)
        while k < stop and src.is_name(k):
            if src.text(k) in ("namespace", "class", "struct", "enum", "union"):
                return k
            k = attributes_end(k + 1)
        return None

    def call(i: int, stop: int) -> int:
        """The bracket of parameters, or an equals sign before it."""
        k = src.until(i, "(=", stop)
        while k < stop and src.text(k) == "(" and src.text(k - 1) in _C_ATTRIBUTES:
            k = src.until(src.close[k] + 1, "(=", stop)
        return k

    def scan(i: int, last: int, container: str, in_class: bool) -> None:
        while i < last:
            first, template = i, False
            if src.text(i) == "template":
                template = True
                depth, i = 0, i + 1
                while i < last:
                    depth += (src.text(i) == "<") - (src.text(i) == ">")
                    i += 1
                    if depth == 0:
                        break
            if src.text(i) == "#":  # a directive is its line
                line = src.place(src.tokens[i].start)[0]
                while i < last and src.place(src.tokens[i].start)[0] == line:
                    i += 1
                continue
            if src.text(i) in ("public", "private", "protected") and src.text(i + 1) == ":":
                i += 2
                continue
            if src.text(i) == "extern" and src.text(i + 2) == "{" and src.tokens[i + 1].kind == "str":
                end = src.close[i + 2]
                scan(i + 3, end, container, in_class)
                i = end + 1
                continue
            if src.text(i) in (";", "}"):
                i += 1
                continue
            stop = src.until(i, "{;", last)
            word, opening = keyword(i, stop), call(i, stop)
            names, k = [], 0
            if word is not None:
                kind = src.text(word)
                k = attributes_end(word + 1 + (kind == "enum" and src.text(word + 1) in ("class", "struct")))
                while k < stop and (src.is_name(k) or src.text(k) == "::"):
                    if src.is_name(k) and src.text(k) != "final":
                        names.append(src.name(k))
                    k = attributes_end(k + 1)
            if word is not None and (k == stop or src.text(k) in (":", "<")):  # else it only names a type
                body = stop
                end = src.close[body] if src.text(body) == "{" else body
                if src.text(body) == "{" and kind != "union":
                    name = "::".join(names) if kind == "namespace" else (names[-1] if names else "")
                    if name:
                        shown = {"class": "template_class", "struct": "template_class"}.get(kind, kind) if template else kind
                        out.append(_symbol(src, name, shown, first, end, container, "::", (), ("public", None), is_template=template))
                    if kind != "enum":
                        scan(body + 1, end, "::".join(x for x in (container, name) if x), kind != "namespace")
                i = (end if src.text(body) == "{" else body) + 1
                continue
            if opening < stop and src.text(opening) == "(" and src.is_name(opening - 1) and src.text(opening - 1) not in _C_WORDS and src.text(i) not in ("using", "typedef", "return", "friend"):
                named, body = opening - 1, src.text(stop) == "{"
                typed = named > i or in_class  # a bare call has no type before it
                end = src.close[stop] if body else stop
                if typed and (body or not in_class):
                    own = ["~" + src.name(named) if src.text(named - 1) == "~" else src.name(named)]
                    k, outer = named - 1 - (src.text(named - 1) == "~"), []
                    while src.text(k) == "::" and src.is_name(k - 1):
                        outer.insert(0, src.name(k - 1))
                        k -= 2
                    path = "::".join(x for x in (container, *outer) if x)
                    kind = "template_function" if template else "method" if in_class or outer else "function"
                    public = any(src.text(j) == "static" for j in range(i, named))
                    out.append(_symbol(src, own[0], kind, first, end, path, "::", _c_parameters(src, opening), ("public", None), is_template=template, is_static=public))
                i = end + 1
                continue
            if src.text(stop) == "{":  # an initialiser or another block
                after = src.close[stop] + 1
                i = after + 1 if src.text(after) == ";" else after
            else:
                i = stop + 1

    scan(0, len(src.tokens), "", False)
    return out


# Java

_JAVA_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}


def java(src: Source) -> list[dict]:
    out: list[dict] = []

    def skip_annotations(i: int) -> int:
        while src.text(i) == "@" and src.text(i + 1) != "interface":
            i += 2
            while src.text(i) == ".":
                i += 2
            if src.text(i) == "(":
                i = src.close[i] + 1
        return i

    def scan(i: int, last: int, container: str, owner: str | None) -> None:
        while i < last:
            if src.text(i) in (";", "}", ","):
                i += 1
                continue
            first = i
            i = skip_annotations(i)
            stop = src.until(i, "{;", last)
            head = [src.text(k) for k in range(i, stop)]
            flags = {"is_public": "public" in head, "is_static": "static" in head}
            seen = ("public", None) if flags["is_public"] else ("private", None)
            word = next((k for k in range(i, stop) if src.text(k) in _JAVA_TYPES and src.is_name(k + 1) and src.text(k - 1) != "."), None)
            opening = src.until(i, "(=", stop)
            block = src.text(stop) == "{"
            end = src.close[stop] if block else stop
            if word is not None and word < opening + (src.text(word) == "record") * 9 and block:
                name = src.name(word + 1)
                out.append(_symbol(src, name, _JAVA_TYPES[src.text(word)], first, end, container, ".", (), seen, **flags))
                inner = f"{container}.{name}" if container else name
                begin = stop + 1
                if src.text(word) == "enum":  # constants come first, up to a semicolon
                    begin = src.until(begin, ";", end) + 1
                scan(begin, end, inner, name)
            elif owner and opening < stop and src.text(opening) == "(" and src.is_name(opening - 1):
                name = src.name(opening - 1)
                typed = opening - 1 > i and src.text(opening - 2) not in ("public", "private", "protected")
                kind = "constructor" if name == owner and not typed else "method"
                names = [[src.name(k) for k in g if src.is_name(k)] for g in parameter_groups(src, opening)]
                out.append(_symbol(src, name, kind, first, end, container, ".", [n[-1] for n in names if n], seen, **flags))
            elif owner and first < stop and src.text(i) not in ("import", "package", "{"):
                cut, depth = i, 0
                while cut < last and (depth or src.text(cut) not in ("=", ";", ",")):  # a comma between type arguments ends nothing
                    depth += (src.text(cut) == "<") - (src.text(cut) == ">")
                    cut += 1
                if src.is_name(cut - 1) and cut - 1 > i:
                    while src.text(end) != ";" and end < last:  # an initialiser may hold blocks
                        end = src.until(end + 1, ";", last)
                    out.append(_symbol(src, src.name(cut - 1), "field", first, end, container, ".", (), seen, **flags))
            i = end + 1

    scan(0, len(src.tokens), "", None)
    return out


# JavaScript and TypeScript

_BLOCK_WORDS = {"if", "for", "while", "switch", "catch", "with", "function", "return", "super", "new", "typeof", "await"}


def ecma(src: Source) -> list[dict]:
    typed = src.language == "typescript"
    out: list[dict] = []

    def names(opening: int) -> list[str]:
        found = []
        for g in parameter_groups(src, opening):
            own = [src.name(k) for k in g if src.is_name(k) and src.text(k) not in ("public", "private", "protected", "readonly")]
            if own:
                found.append(own[0])
        return found

    def statement_end(i: int, last: int) -> int:
        """The semicolon, or else the last token of the line on which all brackets are closed."""
        while i < last:
            t = src.tokens[i]
            if t.text == ";":
                return i
            if i in src.close:
                i = src.close[i]
            nxt = i + 1
            if nxt >= last or (src.place(src.tokens[nxt].start)[0] > src.place(src.end(i) - 1)[0] and src.text(i) not in ("=", "=>", "|", "&", ",", "+", "?", ":", ".") and src.text(nxt) not in (".", "?", ":", "|", "&", "+", "=>")):
                return min(i, last - 1)
            i += 1
        return last - 1

    def body_of(k: int, last: int) -> tuple[int | None, int]:
        """Of a header whose parameters end before k: where its body opens (none: None), and where to go on.

        A return type may hold braces of its own, and ends with the line where no sign carries it on.
        """
        if src.text(k) == "{":
            return k, src.close[k] + 1
        if src.text(k) != ":":
            return None, k + (src.text(k) == ";")
        k += 1
        while k < last:
            t, before = src.text(k), src.text(k - 1)
            if t == ";":
                return None, k + 1
            wanted = before in (":", "|", "&", "=>", "<", ",", "?", "extends", "is", "keyof", "typeof", "readonly", "infer", "asserts", "unique", "new")
            if t == "{" and not wanted:
                return k, src.close[k] + 1
            if not wanted and src.place(src.tokens[k].start)[0] > src.place(src.end(k - 1) - 1)[0] and t not in ("|", "&", "=>", "?", ":", "extends", "is", "[", "<", ">", ".", ","):
                return None, k
            k = src.close[k] + 1 if k in src.close else k + 1
        return None, last

    def members(i: int, last: int, container: str) -> None:
        while i < last:
            first, flags = i, {}
            while src.text(i) == "@":
                i += 2
                if src.text(i) == "(":
                    i = src.close[i] + 1
            while src.text(i) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*", "#", "declare") and src.text(i + 1) not in ("(", "=", ";"):
                flags["is_static"] = flags.get("is_static") or src.text(i) == "static"
                flags["is_async"] = flags.get("is_async") or src.text(i) == "async"
                i += 1
            if src.is_name(i):
                k = i + 1
                if src.text(k) == "<":
                    k = next((j + 1 for j in range(k, last) if src.text(j) == ">"), k)
                if src.text(k) == "(":
                    body, after = body_of(src.close[k] + 1, last)
                    if body is not None:
                        out.append(_symbol(src, src.name(i), "method", first, src.close[body], container, "::", names(k), ("public", None), **flags))
                        scan(body + 1, src.close[body], f"{container}::{src.name(i)}", True)
                    i = max(after, i + 1)
                    continue
            i = statement_end(i, last) + 1 if i < last else last

    def scan(i: int, last: int, container: str, nested: bool = False) -> None:
        while i < last:
            first, flags = i, {"is_exported": False, "is_async": False}
            while src.text(i) in ("export", "default", "async", "declare", "abstract") and src.text(i + 1) not in ("=", ".", "(", "=>"):
                flags["is_exported"] |= src.text(i) == "export"
                flags["is_async"] |= src.text(i) == "async"
                i += 1
            word, named = src.text(i), i + 1
            seen = ("public", None) if flags["is_exported"] else ("private", None)
            if src.text(i - 1) == "." or (i < last and src.tokens[i].kind != "name"):
                i = max(i, first) + 1
                continue
            start = src.tokens[first].start if first < last else 0
            if flags["is_exported"] and src.text(first) == "export":
                start = src.tokens[first + 1].start if src.text(first + 1) != "default" else src.tokens[min(first + 2, last - 1)].start
            if word == "function":
                named += src.text(named) == "*"
                opening = src.until(named, "(", last)
                body = body_of(src.close[opening] + 1, last)[0] if opening < last else None
                if src.is_name(named) and body is not None:
                    end = src.close[body]
                    out.append(_symbol(src, src.name(named), "function", first, end, container, "::", names(opening), seen, start, **flags))
                    scan(body + 1, end, f"{container}::{src.name(named)}" if container else src.name(named), True)
                    i = end + 1
                    continue
            elif word == "class" or (typed and word in ("interface", "enum", "namespace", "module")) or (typed and word == "const" and src.text(i + 1) == "enum"):
                if word == "const":
                    word, named = "enum", i + 2
                body = src.until(named, "{;", last)
                if src.is_name(named) and src.text(body) == "{":
                    end = src.close[body]
                    kind = "namespace" if word == "module" else word
                    out.append(_symbol(src, src.name(named), kind, first, end, container, "::", (), seen, start, **flags))
                    inner = f"{container}::{src.name(named)}" if container else src.name(named)
                    if kind == "class":
                        members(body + 1, end, inner)
                    elif kind == "namespace":
                        scan(body + 1, end, inner)
                    i = end + 1
                    continue
            elif typed and word == "type" and src.is_name(named) and src.text(named + 1) in ("=", "<"):
                end = statement_end(named, last)
                out.append(_symbol(src, src.name(named), "type_alias", first, end, container, "::", (), seen, start, **flags))
                i = end + 1
                continue
            elif word in ("const", "let", "var") and src.is_name(named) and src.text(first - 1) not in ("(", "for"):
                end = statement_end(named, last)
                out.append(_symbol(src, src.name(named), "variable", first, end, container, "::", (), seen, start, **flags))
                scan(named + 1, end, f"{container}::{src.name(named)}" if container else src.name(named), True)
                i = end + 1
                continue
            i += 1

    scan(0, len(src.tokens), "")
    return out


EXTRACTORS = {"rust": rust, "python": python, "c": cpp, "cpp": cpp, "java": java, "javascript": ecma, "typescript": ecma}


def symbols(data: bytes, language: str) -> list[dict]:
    """All declarations; an unknown language has none."""
    extract = EXTRACTORS.get(language)
    return extract(Source(data, language)) if extract else []


def syntax_ok(data: bytes, language: str) -> bool:
    """Whether a source breaks none of the rules that ``grammar`` knows (for Python: whether it compiles); some broken sources pass, as this is no full parser: UTF-8, brackets that match, tokens that keep the rules of their language, and for Python its own compiler's word."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    if language == "python":
        import ast

        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
        return True
    if language not in EXTRACTORS:
        return True
    src = Source(data, language)
    return not src.unbalanced and broken(src) is None
