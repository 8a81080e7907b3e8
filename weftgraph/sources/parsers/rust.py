"""Rust by a structural scan of the blanked source."""

from __future__ import annotations

import re

from ... import schema as S
from .base import Rows, blank, inner, match_close, register, slash_doc
from .javascript import emit_calls

_NOISE = re.compile(r"//[^\r\n]*|/\*.*?(?:\*/|\Z)|b?r(?P<h>#*)\"(?P<s>.*?)\"(?P=h)|\"(?P<s2>(?:[^\"\\]|\\.)*)\"|'(?P<s3>\\[^']+|[^'\\])'", re.S)
_TYPE = re.compile(r"(?:\bpub\b(?:\s*\([^)]*\))?\s+)?\b(struct|enum|union)\s+(\w+)")
_TRAIT = re.compile(r"(?:\bpub\b(?:\s*\([^)]*\))?\s+)?(?:unsafe\s+)?\btrait\s+(\w+)[^{;]*(\{)")
_IMPL = re.compile(r"\bimpl\b\s*(<)?")
_FN = re.compile(r"(?:\bpub\b(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern\s*(?:\"\s*\")?)\s+)*\bfn\s+(\w+)")
_USE = re.compile(r"(?:^|(?<=[;{}\]]))\s*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);")
_CALL = re.compile(r"(?<![\w.:!])(?:\w+(?:::|\.))*(\w+)\(")
_KEYWORDS = frozenset("if for while match return fn loop in let Some Ok Err Box Vec".split())


def _end(text: str, at: int) -> tuple[int, int]:
    """(open brace or -1, end) of the item whose head goes on at ``at``: its braces or its semicolon."""
    while at < len(text) and text[at] not in "{;":
        at = match_close(text, at) if text[at] in "([" else at
        at += 1
    if text[at : at + 1] == "{":
        return at, match_close(text, at)
    return -1, min(at, len(text) - 1)


def parse(rows: Rows, options: dict) -> None:
    text = blank(rows.source, _NOISE)
    bodies: list[tuple[int, int, str]] = []

    def add(kind: str, path: tuple[str, ...], start: int, end: int) -> str:
        line = rows.line_at(start)
        return rows.node(kind, rows.id(*path), path[-1], "::".join((rows.file, *path)), line, rows.line_at(end), slash_doc(rows, line, ("///", "//!")))

    for m in _TYPE.finditer(text):
        open_, end = _end(text, m.end())
        if open_ < 0 and m[1] == "union":
            continue  # a variable of that name
        if open_ >= 0 and m[1] == "struct" and text[m.end() : open_].rstrip().endswith(")"):
            end = open_
        add(S.ENUM if m[1] == "enum" else S.STRUCT, (m[2],), m.start(), end)
    for m in _TRAIT.finditer(text):
        add(S.TRAIT, (m[1],), m.start(), match_close(text, m.start(2)))
    impls: list[tuple[int, int]] = []
    for m in _IMPL.finditer(text):
        before = text[: m.start()].rstrip()
        if before and before[-1] not in ";{}]" and not before.endswith("unsafe"):
            continue  # impl Trait as a type
        at = match_close(text, m.start(1)) + 1 if m[1] else m.end()
        open_ = text.find("{", at)
        if open_ < 0:
            continue
        head = re.split(r"\bwhere\b", text[at:open_])[0].strip()
        parts = re.split(r"\s+for\s+", head, maxsplit=1)
        type_ = re.sub(r"<.*", "", parts[-1], flags=re.S).strip(" &")
        type_ = type_.rsplit("::", 1)[-1]
        if not re.fullmatch(r"\w+", type_):
            continue
        if len(parts) == 2:
            rows.edge(rows.id(type_), rows.id(re.sub(r"\s+", " ", parts[0].strip())), S.IMPLEMENTS)
        close = match_close(text, open_)
        impls.append((open_, close))
        for f in _FN.finditer(inner(text, open_ + 1, close)):
            start = open_ + 1 + f.start()
            a, b = _end(text, open_ + 1 + f.end())
            if a < 0:
                continue
            me = add(S.METHOD, (type_, f[1]), start, b)
            rows.edge(rows.id(type_), me, S.CONTAINS)
            bodies.append((a, b, me))
    for f in _FN.finditer(text):
        a, b = _end(text, f.end())
        if a >= 0 and not any(x < f.start() < y for x, y in impls):
            bodies.append((a, b, add(S.FUNCTION, (f[1],), f.start(), b)))
    for m in _USE.finditer(text):
        rows.edge(rows.file, S.EXTERNAL_PREFIX + rows.source[m.start(1) : m.end(1)].strip(), S.IMPORTS)
    if options.get("emit_calls"):
        emit_calls(rows, text, bodies, _CALL, _KEYWORDS)


register("rust", (".rs",), parse)
