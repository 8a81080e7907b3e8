"""JavaScript and TypeScript by a structural scan of the blanked source."""

from __future__ import annotations

import re

from ... import schema as S
from .base import Rows, blank, block_doc, inner, match_close, register

_NOISE = re.compile(
    r"//[^\r\n]*|/\*.*?(?:\*/|\Z)|\"(?P<s>(?:[^\"\\\r\n]|\\.)*)\"|'(?P<s2>(?:[^'\\\r\n]|\\.)*)'|`(?P<s3>(?:[^`\\]|\\.)*)`"
    r"|(?<=[=(,:\[!&|?{};])[ \t]*/(?![/*])(?:[^/\\\r\n\[]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*",
    re.S,
)
_CLASS = re.compile(r"\bclass\s+([\w$]+)\s*(<[^{}]*?>)?\s*(?:extends\s+([\w$.]+)\s*(?:<[^{}]*?>)?(?:\([^{}]*?\))?)?\s*(?:implements\s+([^{]+?))?\s*(\{)")
_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^(){}]*>)?\s*(\()")
_BOUND = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]+?)?=\s*(?:async\b\s*)?(?:function\b\s*\*?\s*[\w$]*\s*(?=\()|(?:<[^(){}]*>\s*)?(?=\()|[\w$]+\s*=>)")
_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|declare)\s+)*(?:\*\s*)?(\#?[\w$]+)\s*\??(?:<[^(){}]*>)?\s*(\()")
_TYPE = re.compile(r"\b(interface|enum)\s+([\w$]+)[^{};=()]*(\{)")
_IMPORT = re.compile(r"\bimport\b(?:\s*type\b)?[^'\";()]*?(['\"])([^'\"]*)\1")
_REQUIRE = re.compile(r"\brequire\s*\(\s*(['\"`])([^'\"`]*)\1\s*\)")
_CALL = re.compile(r"(?<![\w$.])(?:[\w$]+\.)*([\w$]+)\s*\(")
_KEYWORDS = frozenset("if for while switch catch function return typeof new await do else try finally delete void in of instanceof yield throw with super import require".split())


def _after_parens(text: str, at: int) -> int:
    """The place of the brace that opens the body after the parameters at ``at``, or -1."""
    close = match_close(text, at)
    m = re.compile(r"\s*(?::[^{};=]+(?:\{[^{}]*\}[^{};=]*)?)?\s*(\{)").match(text, close + 1)
    return m.start(1) if m else -1


def parse(rows: Rows, options: dict) -> None:
    ts = rows.language == "typescript"
    src, text = rows.source, blank(rows.source, _NOISE)
    spans: list[tuple[int, int, str]] = []  # classes: (open, close, name)
    bodies: list[tuple[int, int, str]] = []

    def add(kind: str, path: tuple[str, ...], start: int, end: int, doc: bool = True) -> str:
        line = rows.line_at(start)
        return rows.node(kind, rows.id(*path), path[-1], ".".join((rows.file, *path)), line, rows.line_at(end), block_doc(rows, line) if doc else "")

    classes = [(m, m.start(5), match_close(text, m.start(5))) for m in _CLASS.finditer(text)]
    for m, a, b in classes:
        spans.append((a, b, m[1]))
        me = add(S.CLASS, (m[1],), m.start(), b)
        if m[3]:
            rows.edge(me, rows.id(m[3].rsplit(".", 1)[-1]), S.INHERITS)
        if m[4] and ts:
            for x in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", m[4])).split(","):
                if x.strip():
                    rows.edge(me, rows.id(x.strip().rsplit(".", 1)[-1]), S.IMPLEMENTS)
    for m, a, b in classes:
        level, at = inner(text, a + 1, b), 0
        while found := _METHOD.search(level, at):
            paren = a + 1 + found.start(2)
            close = match_close(text, paren)
            at = max(found.end(), min(close, b) - a - 1)
            before = level[: found.start()].rstrip()
            brace = _after_parens(text, paren)
            if found[1] in _KEYWORDS or brace < 0 or (before and before[-1] not in "};{" and "\n" not in level[len(before) : found.start()]) or before.endswith(("=", "=>", "(", ",")):
                continue
            end = match_close(text, brace)
            me = add(S.METHOD, (m[1], found[1]), a + 1 + found.start(), end)
            rows.edge(rows.id(m[1]), me, S.CONTAINS)
            bodies.append((brace, end, me))
            at = max(at, end - a - 1)
    in_class = lambda p: any(a < p < b for a, b, _ in spans)
    for m in _FUNCTION.finditer(text):
        before = text[: m.start()].rstrip()
        brace = _after_parens(text, m.start(2))
        if brace < 0 or in_class(m.start()) or before.endswith(("=", "(", ",", ":", "?", "=>", "return", "&&", "||", "[")):
            continue
        end = match_close(text, brace)
        bodies.append((brace, end, add(S.FUNCTION, (m[1],), m.start(), end)))
    for m in _BOUND.finditer(text):
        rest, at = text[m.end() - 1 : m.end() + 1], m.end()
        if not m[0].rstrip().endswith("=>"):
            close = match_close(text, at)
            tail = re.compile(r"\s*(?::[^={};]+)?\s*(=>|\{)").match(text, close + 1)
            if not tail or (tail[1] == "{") != ("function" in m[0]):
                continue
            at = tail.end() - (tail[1] == "{")
        del rest
        start = re.compile(r"\s*").match(text, at).end()
        if text[start : start + 1] == "{":
            end = match_close(text, start)
        else:
            stop = re.compile(r";|\r?\n[ \t]*\r?\n|\r?\n(?=\S)|\Z").search(text, start)
            end = stop.start()
        me = add(S.FUNCTION, (m[1],), m.start(), max(end, start), False)
        bodies.append((start, end, me))
    if ts:
        for m in _TYPE.finditer(text):
            if m[1] == "interface" or options.get("enums", True):
                add(S.INTERFACE if m[1] == "interface" else S.ENUM, (m[2],), m.start(), match_close(text, m.start(3)))
    for pattern in (_IMPORT, _REQUIRE):
        for m in pattern.finditer(text):
            if name := src[m.start(2) : m.end(2)].strip():
                rows.edge(rows.file, S.EXTERNAL_PREFIX + name, S.IMPORTS)
    if options.get("emit_calls"):
        emit_calls(rows, text, bodies, _CALL, _KEYWORDS)


def emit_calls(rows: Rows, text: str, bodies: list[tuple[int, int, str]], pattern: re.Pattern, keywords: frozenset[str]) -> None:
    """CALLS of the innermost body around each call; calls outside of all bodies are the file's."""
    declared = {(n["line"], n["name"]) for n in rows.nodes}
    for m in pattern.finditer(text):
        if m[1] in keywords or (rows.line_at(m.start(1)), m[1]) in declared:
            continue
        around = [b for b in bodies if b[0] < m.start() < b[1]]
        rows.edge(max(around)[2] if around else rows.file, rows.local_target(m[1]), S.CALLS)


register("javascript", (".js", ".mjs", ".cjs"), parse)
register("typescript", (".ts", ".tsx"), parse)
