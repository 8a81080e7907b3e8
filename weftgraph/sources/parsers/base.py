"""What all parsers share: the row collector, blanking of comments and strings, bracket matching, the registry."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

from ... import schema as S

OUT_SCHEMA = (
    "rec_type string, ordinal int, node_id string, kind string, name string, qualified string, file string, line int, end_line int, language string, "
    "docstring string, signature string, body string, is_async boolean, decorators array<string>, src string, tgt string, edge_kind string, message string"
)
_FIELDS = [x.split()[0] for x in OUT_SCHEMA.split(", ")]


class Rows:
    """Collects what a parser finds in one file."""

    def __init__(self, file: str, source: str, language: str, max_body: int = 0) -> None:
        self.file, self.source, self.language, self.max_body = file, source, language, max_body
        self.lines = source.splitlines()
        self._starts = [0]
        for x in source.splitlines(keepends=True):
            self._starts.append(self._starts[-1] + len(x))
        self.nodes: list[dict] = []
        self.edges: list[tuple[str, str, str]] = []
        self.errors: list[str] = []

    def id(self, *parts: str) -> str:
        return "::".join((self.file, *parts))

    def line_at(self, offset: int) -> int:
        return max(1, bisect_right(self._starts, offset))

    def line(self, n: int) -> str:
        return self.lines[n - 1].strip() if 1 <= n <= len(self.lines) else ""

    def body(self, first: int, last: int) -> str:
        got = self.lines[first - 1 : last] if 1 <= first <= last else []
        if 0 < self.max_body < len(got):
            got = [*got[: self.max_body], f"# ... ({len(got) - self.max_body} more lines)"]
        return "\n".join(got)

    def node(self, kind: str, node_id: str, name: str, qualified: str, start: int, end: int, docstring: str = "", is_async: bool = False, decorators: tuple[str, ...] = ()) -> str:
        self.nodes.append({
            "node_id": node_id, "kind": kind, "name": name, "qualified": qualified, "file": self.file, "line": start, "end_line": end, "language": self.language,
            "docstring": docstring, "signature": self.line(start), "body": self.body(start, end), "is_async": is_async, "decorators": list(decorators),
        })
        return node_id

    def edge(self, src: str, tgt: str, kind: str) -> None:
        self.edges.append((src, tgt, kind))

    def local_target(self, name: str) -> str:
        """The first symbol of that name in this file, else the id of an unresolved call."""
        return next((n["node_id"] for n in self.nodes if n["name"] == name), S.UNRESOLVED_PREFIX + name)

    def tuples(self) -> list[tuple]:
        """Rows of OUT_SCHEMA."""
        made = [{"rec_type": "node", "ordinal": i, **n} for i, n in enumerate(self.nodes)]
        made += [{"rec_type": "edge", "ordinal": i, "file": self.file, "src": s, "tgt": t, "edge_kind": k} for i, (s, t, k) in enumerate(self.edges)]
        made += [{"rec_type": "error", "ordinal": i, "file": self.file, "message": m} for i, m in enumerate(self.errors)]
        return [tuple(m.get(f) for f in _FIELDS) for m in made]


def blank(source: str, pattern: re.Pattern) -> str:
    """``source`` with comments and the inside of strings blanked, lengths and line ends kept.

    ``pattern`` has a group ``s`` around the inside of each string; all else that it matches is a comment.
    """

    def fill(text: str) -> str:
        return re.sub(r"[^\r\n]", " ", text)

    def swap(m: re.Match) -> str:
        for name in ("s", "s2", "s3"):
            if name in m.re.groupindex and m.group(name) is not None:
                a, b = m.start(name) - m.start(), m.end(name) - m.start()
                return m[0][:a] + fill(m.group(name)) + m[0][b:]
        return fill(m[0])

    return pattern.sub(swap, source)


_PAIRS = {"{": "}", "(": ")", "[": "]", "<": ">"}


def match_close(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; the text's end if there is none."""
    open_, close, depth = text[at], _PAIRS[text[at]], 0
    for m in re.compile("[" + re.escape(open_ + close) + "]").finditer(text, at):
        depth += 1 if m[0] == open_ else -1
        if depth == 0:
            return m.start()
    return len(text)


def inner(text: str, a: int, b: int) -> str:
    """``text[a:b]`` with all that is inside of further braces blanked, the braces kept."""
    out, depth = [], 0
    for c in text[a:b]:
        if c == "}":
            depth -= 1
        out.append(c if depth <= 0 or c == "\n" else " ")
        if c == "{":
            depth += 1
    return "".join(out)


def block_doc(rows: Rows, line: int) -> str:
    """The ``/* */`` comment that ends on the line above, its lines stripped."""
    if line < 2 or not rows.line(line - 1).endswith("*/"):
        return ""
    first = line - 1
    while first > 1 and not rows.line(first).startswith("/*"):
        first -= 1
    return "\n".join(x.strip() for x in rows.lines[first - 1 : line - 1])


def starred_doc(rows: Rows, line: int) -> str:
    """The ``/** */`` comment just above, every line of which begins with an asterisk."""
    for first in range(line - 1, 0, -1):
        text = rows.line(first)
        if text.startswith("/**"):
            return "\n".join(x.strip() for x in rows.lines[first - 1 : line - 1])
        if not text.startswith(("*", "/*")):
            return ""
    return "\n".join(x.strip() for x in rows.lines[: line - 1]) if line > 1 else ""


def slash_doc(rows: Rows, line: int, marks: tuple[str, ...]) -> str:
    """The run of line comments just above, without their marks, joined by spaces."""
    got = []
    for n in range(line - 1, 0, -1):
        text = rows.line(n)
        mark = next((m for m in marks if text.startswith(m)), None)
        if mark is None:
            break
        got.append(text.lstrip("/! " if "!" in mark else "/ ").strip())
    return " ".join(reversed(got))


Parser = Callable[[Rows, dict], None]
_REGISTRY: dict[str, tuple[str, Parser]] = {}


def register(language: str, extensions: tuple[str, ...], parser: Parser) -> None:
    """Let ``parser`` read the files of ``extensions``; it gets the row collector and the options."""
    for e in extensions:
        _REGISTRY[e.lower()] = (language, parser)


def _all() -> dict[str, tuple[str, Parser]]:
    from . import go, java, javascript, python, rust  # noqa: F401  each registers itself

    return _REGISTRY


def parser_for(path: str) -> tuple[str, Parser] | None:
    name = path.rsplit("/", 1)[-1]
    return _all().get("." + name.rsplit(".", 1)[-1].lower()) if "." in name[1:] else None


def supported_extensions() -> list[str]:
    return sorted(_all())


def supported_languages():
    """The languages' names. TypeScript is read by the JavaScript parser and not named apart."""
    return sorted({lang for lang, _ in _all().values()} - {"typescript"})


def parse_source(path: str, source: str | None, options: dict | None = None) -> Rows:
    """All rows of one file. A file of an unknown kind has none; what goes wrong becomes an error row."""
    options = options or {}
    found = parser_for(path)
    rows = Rows(path, source or "", found[0] if found else "", int(options.get("max_body_lines", 0)))
    if source is None:
        rows.errors.append(f"{path}: cannot be read")
    elif found:
        try:
            found[1](rows, options)
        except Exception as e:  # noqa: BLE001  any failure of a parser is that file's error row
            rows.errors.append(f"{path}: {type(e).__name__}: {e}")
    return rows
