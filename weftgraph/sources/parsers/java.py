"""Java by a structural scan of the blanked source."""

from __future__ import annotations

import re

from ... import schema as S
from .base import Rows, blank, inner, match_close, register, starred_doc
from .javascript import emit_calls

_NOISE = re.compile(r"//[^\r\n]*|/\*.*?(?:\*/|\Z)|\"\"\"(?P<s>.*?)\"\"\"|\"(?P<s2>(?:[^\"\\\r\n]|\\.)*)\"|'(?P<s3>(?:[^'\\\r\n]|\\.)+)'", re.S)
_TYPE = re.compile(r"(?<![@\w.])(class|interface|enum)\s+(\w+)([^{};]*)(\{)")
_IMPORT = re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", re.M)
_ANNOTATION = re.compile(r"@\w+(?:\.\w+)*")
_HEAD = re.compile(r"(?:^|[\s>\]])(\w+)\s*\($")
_CALL = re.compile(r"(?<![\w.])(?:\w+\.)*(\w+)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return new synchronized try super this assert throw".split())


def _no_annotations(text: str) -> str:
    """Annotations and their arguments blanked, lengths kept."""
    out, at = list(text), 0
    while m := _ANNOTATION.search(text, at):
        end = m.end()
        if m[0] == "@interface":
            at = end
            continue
        p = re.compile(r"\s*\(").match(text, end)
        if p:
            end = min(match_close(text, p.end() - 1) + 1, len(text))
        out[m.start() : end] = [c if c in "\r\n" else " " for c in text[m.start() : end]]
        at = end
    return "".join(out)


def _names(clause: str) -> list[str]:
    while (less := re.sub(r"<[^<>]*>", "", clause)) != clause:
        clause = less
    return [x.strip().rsplit(".", 1)[-1] for x in clause.split(",") if x.strip()]


def parse(rows: Rows, options: dict) -> None:
    text = blank(rows.source, _NOISE)
    bodies: list[tuple[int, int, str]] = []

    def begin(at: int, floor: int = 0) -> int:
        """Where the declaration that holds ``at`` begins, with its modifiers and annotations."""
        depth = 0
        for i in range(at - 1, floor - 1, -1):
            depth += {")": 1, "(": -1}.get(text[i], 0)
            if depth == 0 and text[i] in ";{}":
                return i + 1 + len(text[i + 1 : at]) - len(text[i + 1 : at].lstrip())
        return floor + len(text[floor:at]) - len(text[floor:at].lstrip())

    def add(kind: str, path: tuple[str, ...], start: int, end: int, doc: bool = True, me: str | None = None) -> str:
        line = rows.line_at(start)
        return rows.node(kind, me or rows.id(*path), path[-1], ".".join((rows.file, *path)), line, rows.line_at(end), starred_doc(rows, line) if doc else "")

    types = [(m[1], m[2], m[3], begin(m.start()), m.start(4), match_close(text, m.start(4))) for m in _TYPE.finditer(text)]
    for what, name, head, start, _, end in types:
        if what == "class":
            me = add(S.CLASS, (name,), start, end)
            head = re.split(r"\bpermits\b", head)[0]
            if m := re.search(r"\bextends\s+(.*?)(?=\bimplements\b|$)", head, re.S):
                for b in _names(m[1]):
                    rows.edge(me, rows.id(b), S.INHERITS)
            if m := re.search(r"\bimplements\s+(.*)$", head, re.S):
                for b in _names(m[1]):
                    rows.edge(me, rows.id(b), S.IMPLEMENTS)
    for kind in ("interface", "enum"):
        for what, name, _, start, _, end in types:
            if what == kind:
                add(S.INTERFACE if kind == "interface" else S.ENUM, (name,), start, end, kind == "interface")
    methods = []
    for what, name, _, _, open_, close in types:
        owner = name
        if what == "enum":
            around = [t for t in types if t[0] != "enum" and t[4] < open_ < t[5]]
            if not around:
                continue
            owner = max(around, key=lambda t: t[4])[1]
        level = _no_annotations(inner(text, open_ + 1, close))
        first = level.find(";") + 1 or len(level) if what == "enum" else 0  # behind an enum's constants
        member, depth = first, 0
        for m in re.compile(r"[;{}()]").finditer(level, first):
            i = m.start()
            if m[0] in "()":
                depth += 1 if m[0] == "(" else -1
            elif depth == 0 and m[0] == "}":
                member = i + 1
            elif depth == 0:
                head = level[member:i]
                found = re.search(r"(\w+)\s*\(", head)
                if found and "=" not in head[: found.start()] and not re.search(r"\b(?:class|interface|enum|record|new)\b", head[: found.start()]) and re.search(r"\)\s*(?:\[\s*\]\s*)*(?:throws\b[\w\s.,]*)?(?:default\b.*)?$", head, re.S):
                    whole = text[open_ + 1 + member : open_ + 1 + i]
                    start = open_ + 1 + member + len(whole) - len(whole.lstrip())
                    end = match_close(text, open_ + 1 + i) if m[0] == "{" else open_ + 1 + i
                    methods.append((start, owner, found[1], end, open_ + 1 + i if m[0] == "{" else -1))
                if m[0] == ";":
                    member = i + 1
    seen: set[str] = set()
    for start, owner, name, end, open_ in sorted(methods):
        me = rows.id(owner, name)
        if me in seen:
            me += f"_{rows.line_at(start)}"
        seen.add(me)
        add(S.METHOD, (owner, name), start, end, True, me)
        rows.edge(rows.id(owner), me, S.CONTAINS)
        if open_ >= 0:
            bodies.append((open_, end, me))
    for m in _IMPORT.finditer(text):
        rows.edge(rows.file, S.EXTERNAL_PREFIX + m[1], S.IMPORTS)
    if options.get("emit_calls"):
        emit_calls(rows, text, bodies, _CALL, _KEYWORDS)


register("java", (".java",), parse)
