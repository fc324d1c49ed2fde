"""Tokens, comments and matching brackets of a source."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_NAME = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_REST = rf"(?P<name>{_NAME})|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|\.\.\.|[^\s\w])"
_C_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_LEXERS = {
    "rust": rf"(?P<str>b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]+?|[^\\'\n])'|'(?=[A-Za-z_]){_NAME})|{_C_COMMENT}|",
    "python": r"(?P<comment>\#[^\n]*)|(?P<str>[rbfuRBFU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _QUOTED + "))|",
    "c": rf"{_C_COMMENT}|(?P<str>(?:R\"(?P<h>[^(\s]*)\(.*?\)(?P=h)\")|{_QUOTED})|",
    "java": rf"{_C_COMMENT}|(?P<str>\"\"\".*?(?:\"\"\"|\Z)|{_QUOTED})|",
    "javascript": rf"{_C_COMMENT}|(?P<str>`(?:\\.|[^`\\])*`?|{_QUOTED})|",
}
_LEXERS = {k: re.compile(v + (_REST.replace("(?P<name>", "(?P<name>(?:r#)?", 1) if k == "rust" else _REST), re.DOTALL) for k, v in _LEXERS.items()}
_RUST_OPEN = re.compile(r"/\*|\*/")
_FAMILY = {"cpp": "c", "typescript": "javascript"}
_JS_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words of JavaScript that an operand follows.
_BEFORE_OPERAND = frozenset("return typeof case in of do else void delete instanceof new throw yield await".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Source:
    """Tokens without comments; ``close`` maps an opening bracket's index to its closing one's, ``opened`` the other way."""

    data: bytes
    language: str
    tokens: list[Token] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    close: dict[int, int] = field(default_factory=dict)
    unbalanced: bool = False
    opened: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        text = self.data.decode("latin-1")
        lexer, at = _LEXERS[_FAMILY.get(self.language, self.language)], 0
        while m := lexer.search(text, at):
            at = max(m.end(), m.start() + 1)
            kind = m.lastgroup if m.lastgroup != "h" else "str"
            if m[0] == "/" and lexer is _LEXERS["javascript"] and (pattern := self._pattern(text, m.start())):
                self.tokens.append(Token("str", pattern, m.start(), m.start() + len(pattern)))
                at = m.start() + len(pattern)
                continue
            if kind == "comment":
                if self.language == "rust" and m[0].startswith("/*"):  # these nest
                    at = self._nested_end(text, m.start())
                self.comments.append((m.start(), at))
            else:
                self.tokens.append(Token(kind, m[0], m.start(), m.end()))
        waiting: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in _PAIRS:
                waiting.append(i)
            elif t.text in _PAIRS.values():
                if waiting and _PAIRS[self.tokens[waiting[-1]].text] == t.text:
                    self.close[waiting.pop()] = i
                else:
                    self.unbalanced = True
        self.unbalanced |= bool(waiting)
        for i in waiting:  # what is never closed ends with the source
            self.close[i] = len(self.tokens)
        self.opened = {c: o for o, c in self.close.items()}
        self._lines = [0, *(m.end() for m in re.finditer(rb"\n", self.data))]

    def _pattern(self, text: str, at: int) -> str | None:
        """The regular expression that a slash opens where an operand may stand."""
        last = self.tokens[-1] if self.tokens else None
        if last and (last.kind in ("num", "str") or last.text in (")", "]", "}") or (last.kind == "name" and last.text not in _BEFORE_OPERAND)):
            return None
        m = _JS_PATTERN.match(text, at)
        return m[0] if m else None

    @staticmethod
    def _nested_end(text: str, at: int) -> int:
        depth = 0
        for m in _RUST_OPEN.finditer(text, at):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(text)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def name(self, i: int) -> str:
        """The name that a token stands for; r# only says that it is no keyword."""
        return decoded(self.tokens[i].text.removeprefix("r#"))

    def end(self, i: int) -> int:
        """Byte end of a token; of one past the last, the source's end without white space."""
        return self.tokens[i].end if i < len(self.tokens) else len(self.data.rstrip())

    def until(self, i: int, stops: str, last: int | None = None) -> int:
        """Index of the next of ``stops`` outside brackets that open after i; ``last`` or the number of tokens if none."""
        last = len(self.tokens) if last is None else last
        while i < last:
            t = self.tokens[i].text
            if self.tokens[i].kind == "op":
                if t in stops:
                    return i
                if t in _PAIRS:
                    i = self.close[i]
            i += 1
        return last

    def place(self, at: int) -> tuple[int, int]:
        """Line from 1 and byte column from 0."""
        line = bisect_right(self._lines, at)
        return line, at - self._lines[line - 1]


def decoded(text: str) -> str:
    return text.encode("latin-1").decode("utf-8", "replace")


def parameter_groups(src: Source, opening: int) -> list[list[int]]:
    """Token indexes between the commas of a bracket, those inside brackets or <> not counted as commas."""
    out, own, depth, i = [], [], 0, opening + 1
    last = min(src.close[opening], len(src.tokens))
    while i < last:
        t = src.tokens[i].text
        if t == "," and depth <= 0:
            out.append(own)
            own = []
        else:
            own.append(i)
            depth += (t == "<") - (t == ">")
            if src.tokens[i].kind == "op" and t in _PAIRS:
                end = min(src.close[i], last)
                own.extend(range(i + 1, end + 1))
                i = end
        i += 1
    return [g for g in [*out, own] if g]
