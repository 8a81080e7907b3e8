"""Go by a structural scan of the blanked source."""

from __future__ import annotations

import re

from ... import schema as S
from .base import Rows, blank, match_close, register, slash_doc
from .javascript import emit_calls

_NOISE = re.compile(r"//[^\r\n]*|/\*.*?(?:\*/|\Z)|\"(?P<s>(?:[^\"\\\r\n]|\\.)*)\"|`(?P<s2>[^`]*)`|'(?P<s3>(?:[^'\\\r\n]|\\.)+)'", re.S)
_TYPE = re.compile(r"^[ \t]*type\s+(\w+)\s*(?:\[[^\]]*\])?\s*(struct|interface)\s*(\{)", re.M)
_GROUP = re.compile(r"^[ \t]*(type|import)\s*(\()", re.M)
_IN_GROUP = re.compile(r"^[ \t]*(\w+)\s*(?:\[[^\]]*\])?\s*(struct|interface)\s*(\{)", re.M)
_FUNC = re.compile(r"^func\s+(\w+)\s*(?:\[[^\]]*\])?\s*(\()", re.M)
_METHOD = re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)\s*(?:\[[^\]]*\])?\s*\)\s*(\w+)\s*(\()", re.M)
_IMPORT = re.compile(r"^[ \t]*import\s+(?:[\w.]+\s+)?(\"[^\"]*\"|`[^`]*`)", re.M)
_CALL = re.compile(r"(?<![\w.])(?:\w+\.)*(\w+)\(")
_KEYWORDS = frozenset("if for switch select func return go defer range make new len cap append copy delete panic recover print println close string int error byte rune".split())


def _body(text: str, paren: int) -> tuple[int, int]:
    """The braces of the function whose parameters open at ``paren``; both at the line's end if it has none."""
    at = match_close(text, paren) + 1
    while at < len(text) and text[at] not in "{\n":
        if text[at] in "([":
            at = match_close(text, at)
        elif (m := re.compile(r"(?:interface|struct)\s*(?=\{)").match(text, at)) and not text[at - 1].isalnum():
            at = match_close(text, m.end())
        at += 1
    if text[at : at + 1] == "{":
        return at, match_close(text, at)
    return at, at


def parse(rows: Rows, options: dict) -> None:
    text = blank(rows.source, _NOISE)
    bodies: list[tuple[int, int, str]] = []

    def add(kind: str, path: tuple[str, ...], start: int, end: int) -> str:
        line = rows.line_at(start)
        return rows.node(kind, rows.id(*path), path[-1], ".".join((rows.file, *path)), line, rows.line_at(end), slash_doc(rows, line, ("//",)))

    def start_of(m: re.Match) -> int:
        return m.start() + len(m[0]) - len(m[0].lstrip())

    groups = [(g[1], g.start(2), match_close(text, g.start(2))) for g in _GROUP.finditer(text)]
    types = [(start_of(m), m[1], m[2], match_close(text, m.start(3))) for m in _TYPE.finditer(text)]
    for what, a, b in groups:
        at = a + 1
        while what == "type" and (m := _IN_GROUP.search(text, at, b)):
            end = match_close(text, m.start(3))
            types.append((start_of(m), m[1], m[2], end))
            at = end + 1
    for start, name, what, end in sorted(types):
        add(S.STRUCT if what == "struct" else S.INTERFACE, (name,), start, end)
    for m in _FUNC.finditer(text):
        a, b = _body(text, m.start(2))
        bodies.append((a, b, add(S.FUNCTION, (m[1],), m.start(), b)))
    for m in _METHOD.finditer(text):
        a, b = _body(text, m.start(3))
        me = add(S.METHOD, (m[1], m[2]), m.start(), b)
        rows.edge(rows.id(m[1]), me, S.CONTAINS)
        bodies.append((a, b, me))
    paths = [(m.start(1), m.end(1)) for m in _IMPORT.finditer(text)]
    for what, a, b in groups:
        if what == "import":
            paths += [(m.start(), m.end()) for m in re.compile(r"\"[^\"]*\"|`[^`]*`").finditer(text, a, b)]
    for a, b in sorted(paths):
        if name := rows.source[a + 1 : b - 1]:
            rows.edge(rows.file, S.EXTERNAL_PREFIX + name, S.IMPORTS)
    if options.get("emit_calls"):
        emit_calls(rows, text, bodies, _CALL, _KEYWORDS)


register("go", (".go",), parse)
