"""Rules that tokens of a well-formed source keep, besides brackets that match.

The rules are those that no valid source breaks, so a source may pass that a full
parser would refuse, but none is refused that a full parser would pass. What a
macro is given is left out, as it need follow no rule.
"""

from __future__ import annotations

from lexispan.parse.lexer import Source

#: Words that cannot be names, by language.
RESERVED = {
    "rust": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split(),
    "c": "auto break case char const continue default do double else enum extern float for goto if int long register return short signed sizeof static struct switch typedef union unsigned void volatile while".split(),
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split(),
    "javascript": "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split(),
}
RESERVED["cpp"] = [*RESERVED["c"], *"bool catch class delete explicit export false friend inline mutable namespace new operator private protected public template this throw true try typename using virtual".split()]
RESERVED["typescript"] = [*RESERVED["javascript"], "enum"]
RESERVED = {k: frozenset(v) for k, v in RESERVED.items()}
#: Words that a name must follow.
NAMED = {
    "rust": {"struct", "enum", "trait", "mod"}, "c": set(), "cpp": set(), "java": {"class", "interface", "enum"}, "javascript": set(), "typescript": {"interface", "enum"},
}
#: Words that a name, a body, or something else that is no reserved word must follow.
OPEN_NAMED = {"c": {"struct", "union", "enum"}, "cpp": {"class", "struct", "union", "namespace"}, "javascript": {"class"}, "typescript": {"class"}}
#: Types of which no two stand side by side.
BASIC = {"c": {"void", "char", "int", "float", "double"}, "cpp": {"void", "bool", "char", "int", "float", "double"}, "java": {"void", "boolean", "byte", "char", "short", "int", "long", "float", "double"}}
_LET = {"rust": {"let"}, "javascript": {"let", "const", "var"}, "typescript": {"let", "const", "var"}}
#: Words of Rust that are names elsewhere.
_RUST_SOFT = {"union", "auto", "default", "macro_rules", "raw", "safe", "gen", "yield", "try", "do", "box", "macro", "priv", "static", "builtin"}
_SIGNS = "+-*/%=<>!&|^~?:.@"


def _left_out(src: Source) -> list[bool]:
    """Tokens that need keep no rule: directives of C, and what macros of Rust are given."""
    n = len(src.tokens)
    out = [False] * n
    i = 0
    while i < n:
        if src.language in ("c", "cpp") and src.text(i) == "#":
            end = src.data.find(b"\n", src.tokens[i].start)
            while end > 0 and src.data[end - 1 : end] == b"\\":
                end = src.data.find(b"\n", end + 1)
            while i < n and (end < 0 or src.tokens[i].start < end):
                out[i] = True
                i += 1
            continue
        if src.language == "rust" and (src.text(i) == "!" or src.text(i) == "#"):
            opening = next((k for k in (i + 1, i + 2) if k in src.close and not (k == i + 2 and not src.is_name(i + 1) and src.text(i + 1) != "!")), None)
            if opening is not None and (src.text(i) == "#" or src.is_name(i - 1)):
                for k in range(i, min(src.close[opening] + 1, n)):
                    out[k] = True
                i = src.close[opening] + 1
                continue
        i += 1
    return out


def broken(src: Source) -> int | None:
    """The first token that breaks a rule; none: None."""
    lang = src.language
    reserved, named, open_named, basic, lets = RESERVED.get(lang, frozenset()), NAMED.get(lang, set()), OPEN_NAMED.get(lang, set()), BASIC.get(lang, set()), _LET.get(lang, set())
    out = _left_out(src)
    typed = lang in ("c", "cpp", "java")

    def touches(i: int) -> bool:
        """A sign before it is part of the same operator."""
        return i > 0 and src.tokens[i - 1].end == src.tokens[i].start and src.tokens[i - 1].kind == "op" and src.text(i - 1) in _SIGNS

    for i, t in enumerate(src.tokens):
        if out[i]:
            continue
        word, nxt, before = t.text, src.text(i + 1), src.text(i - 1)
        if t.kind == "name" and before not in (".", "::", "->", "@", "?") and nxt not in (":", "=>"):
            if word in named and not (src.is_name(i + 1) and nxt not in reserved):
                return i
            if word in open_named and src.is_name(i + 1) and nxt in reserved and nxt not in ("class", "struct", "extends", "final") or (word in open_named and nxt == word):
                return i
            if word in lets and (nxt in ("=", ";", ")", "}", ",") or (lang == "rust" and nxt in reserved - {"mut", "ref", "crate", "self", "Self", "super", "const", "true", "false"})):
                return i
            if word == "fn" and lang == "rust" and not (nxt == "(" or (src.is_name(i + 1) and nxt not in reserved)):
                return i
            if word in basic and src.is_name(i + 1) and nxt in basic:
                return i
            if lang == "rust" and word not in reserved | _RUST_SOFT and src.is_name(i + 1) and nxt not in reserved | _RUST_SOFT and before != "!":
                return i
        if t.kind == "op" and word == "=" and not touches(i) and not (src.text(i + 1) in tuple("=>") and src.tokens[i + 1].start == t.end):
            alone = before in ("(", ",") and nxt in (")", ",")  # what a macro may be given
            if nxt in (";", ")", "}", "=") and before not in ("operator", "[") and not alone:
                return i
            if before in (";", "{") or (before == "(" and src.text(i - 2) != "operator" and not alone):
                return i
        if t.kind == "op" and word in "+-%" and lang in ("rust", "c", "cpp", "java") and nxt in (";", ")", "}") and not touches(i) and not (lang == "java" and before == "?") and before != "operator":
            if not (nxt == ")" and (before in ("(", ",") or (lang == "rust" and word == "+"))):  # given to a macro; bounds may end in a plus
                return i
        if word == "->" and lang == "rust" and nxt in ("{", ";", ")"):
            return i
        if typed and word == "{" and before == ")":
            last = min(src.close[i], len(src.tokens)) - 1
            start = last
            while start > i and src.text(start) not in (";", "{", "}"):
                start -= 1
            if last > start and src.tokens[last].kind in ("name", "num", "str") and src.text(start + 1) in ("return", "break", "continue", "throw", "goto") and not out[last]:
                return last
    return None
