"""Scopes, what they declare and from where on, and identifier occurrences of Rust sources."""

from __future__ import annotations

from lexispan.parse.lexer import Source, parameter_groups

_WORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())


def _pattern_names(src: Source, a: int, b: int) -> list[int]:
    """Token indexes of the names that a pattern binds: neither types, nor paths, nor constructors, nor fields' own names."""
    return [k for k in range(a, b) if src.is_name(k) and src.text(k) not in _WORDS and src.text(k + 1) not in ("::", "(", "{", ":", "!") and src.text(k - 1) not in ("::", ".") and not src.text(k)[:1].isupper()]


def scopes(src: Source) -> tuple[list[dict], list[dict]]:
    """(scopes, declarations). Scope 0 is the file; a function's parameters belong to its body, as do a closure's to what it covers."""
    n = len(src.tokens)
    spans: list[tuple[int, int]] = [(0, len(src.data))]
    declared: list[dict] = []

    def scope(first: int, last: int) -> int:
        spans.append((src.tokens[first].start, src.end(last)))
        return len(spans) - 1

    by_open: dict[int, int] = {}
    for o in sorted(src.close):
        if src.text(o) == "{":
            by_open[o] = scope(o, src.close[o])

    inner, waiting = [0] * n, [(n, 0)]  # of each token the innermost scope, from those open at it
    for k in range(n):
        while k >= waiting[-1][0]:
            waiting.pop()
        inner[k] = waiting[-1][1]
        if k in by_open:
            waiting.append((src.close[k], by_open[k]))

    def around(at: int) -> int:
        """The innermost scope of a token."""
        return inner[at]

    def loop_in(k: int, stop: int) -> int | None:
        """The ``in`` of a loop's header, behind a pattern of any length."""
        while k < stop:
            if src.text(k) == "in":
                return k
            k = src.close[k] + 1 if k in src.close else k + 1
        return None

    def declare(scope_id: int, k: int, at: int | None = None) -> None:
        declared.append({"scope_id": scope_id, "name": src.name(k), "declaration_pos": src.tokens[k].start if at is None else at})

    for i in range(n):
        word = src.text(i)
        if word == "fn" and src.is_name(i + 1):
            body = src.until(i + 1, "{;")
            outer = around(i)
            if outer:
                declare(outer, i + 1, src.tokens[i].start)
            else:
                declare(0, i + 1, 0)
            opening = src.until(i + 2, "(", body)
            if body in by_open and opening < body:
                for g in parameter_groups(src, opening):
                    cut = next((p for p, k in enumerate(g) if src.text(k) == ":"), len(g))
                    for k in _pattern_names(src, g[0], g[0] + cut) or ([g[cut - 1]] if cut and cut < len(g) and src.is_name(g[cut - 1]) else []):
                        declare(by_open[body], k, spans[by_open[body]][0])
        elif word == "let":
            end = src.until(i + 1, "=;:")
            for k in _pattern_names(src, i + 1, end) or ([end - 1] if src.is_name(end - 1) and src.text(end - 1) not in _WORDS else []):
                declare(around(i), k)
        elif word == "for" and src.text(i - 1) != ">" and not src.is_name(i - 1):
            at = loop_in(i + 1, n)
            body = src.until(at, "{;") if at else n  # a pattern may have braces of its own
            if at and body in by_open:
                for k in _pattern_names(src, i + 1, at):
                    declare(by_open[body], k, spans[by_open[body]][0])
        elif word == "=>":  # names of a match arm, in the scope around it
            a = i - 1
            while a > 0 and src.text(a) not in (",", "{", "}", ";", "=>"):
                a = src.opened.get(a, a) - 1
            for k in _pattern_names(src, a + 1, i):
                if src.text(k - 1) != "if":
                    declare(around(i), k)
        elif word == "|" and src.text(i - 1) in ("(", ",", "=", "move", "return", "{", ";", "=>"):
            end = next((k for k in range(i + 1, n) if src.text(k) == "|"), None)
            if end is None:
                continue
            last = src.close[end + 1] if end + 1 in src.close and src.text(end + 1) == "{" else src.until(end + 1, ",;)}]")
            if last == end + 1 or end + 1 >= n:
                continue
            own = scope(i, last if src.text(last) == "}" and src.text(end + 1) == "{" else last - 1)
            for k in range(i + 1, end):
                if src.is_name(k) and src.text(k) not in _WORDS and src.text(k - 1) in ("|", ",", "mut", "&", "("):
                    declare(own, k)
    parents: list[int | None] = [None] * len(spans)
    held: list[int] = []
    for i in sorted(range(len(spans)), key=lambda j: (spans[j][0], -spans[j][1], j)):
        while held and spans[held[-1]][1] <= spans[i][0] and spans[held[-1]][1] < spans[i][1]:
            held.pop()
        parents[i] = next((j for j in reversed(held) if spans[j][1] >= spans[i][1]), None)
        held.append(i)
    rows = [{"scope_id": i, "parent_id": parents[i], "byte_start": a, "byte_end": b} for i, (a, b) in enumerate(spans)]
    return rows, declared


def identifiers(src: Source) -> list[dict]:
    """Every name, with what it stands in; a path is one occurrence, of its last name."""
    out, n = [], len(src.tokens)
    in_use = set()
    for i in range(n):
        if src.text(i) == "use" and src.tokens[i].kind == "name":
            in_use.update(range(i, src.until(i, ";")))
    for i, t in enumerate(src.tokens):
        if t.kind != "name" or t.text in _WORDS - {"self"} or src.text(i + 1) == "::":
            continue
        first = i
        while src.text(first - 1) == "::" and src.is_name(first - 2):
            first -= 2
        qualified = first < i
        before, after = src.text(first - 1), src.text(i + 1)
        call = after == "("
        if i in in_use:
            parent = "use"
        elif src.text(i - 1) in ("fn", "struct", "enum", "trait", "mod"):
            parent = "definition"
        elif call:
            parent = "call"
        elif before == ".":
            parent = "field"
        elif before in (":", "->") or (before == "for" and src.text(first - 2) != "{"):
            parent = "type"
        elif before == "<" or (before == "," and after == ">"):
            parent = "generic"
        else:
            parent = "other"
        kind = "method_call" if before == "." and call else "scoped_identifier" if qualified else "field" if before == "." else "identifier"
        whole = src.data[src.tokens[first].start : t.end].decode("utf-8", "replace")
        out.append({"name": src.name(i), "node_kind": kind, "parent_kind": parent, "byte_start": t.start if kind == "method_call" else src.tokens[first].start, "byte_end": t.end, "is_qualified": qualified, "qualified_text": whole if qualified else None})
    return out
