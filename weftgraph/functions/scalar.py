"""Scalar functions of the graph engine, all of them Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Python's ``str.splitlines`` sees them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: White space as Python's ``str.strip`` sees it.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_EXTENSIONS = {"go": "go", "java": "java", "javascript": "cjs js mjs", "python": "py", "rust": "rs", "typescript": "ts tsx"}
LANGUAGE_OF_EXTENSION = {f".{x}": language for language, names in _EXTENSIONS.items() for x in names.split()}

_EXCLUDED_FOLDERS, _EXCLUDED_FILES = "build dist venv .venv .git node_modules __pycache__", "*.min.css *.min.js"
DEFAULT_EXCLUDES = (*(f"**/{x}/**" for x in _EXCLUDED_FOLDERS.split()), *(f"**/{x}" for x in _EXCLUDED_FILES.split()))


def node_id(*parts: Column | str) -> Column:
    return F.concat_ws("::", *parts)


def external_id(module: Column | str, symbol: Column | str | None = None) -> Column:
    return F.concat_ws("::", F.lit("ext"), module, *([] if symbol is None else [symbol]))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``, POSIX style; a path outside of it is kept whole."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def strip(text: Column) -> Column:
    """Without the white space around it, whatever its kind."""
    return F.btrim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    """The text's lines; a line end at the very end opens no further line. Null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def cap_body(body: Column, most: int) -> Column:
    """The first ``most`` lines and a remark on how many follow; the whole body when ``most`` is not positive."""
    if most <= 0:
        return body
    n = F.size(lines(body))
    head = F.array_join(F.slice(lines(body), 1, most), "\n")
    return F.when(n > most, F.concat(head, F.lit("\n# ... ("), (n - most).cast("string"), F.lit(" more lines)"))).otherwise(body)


def get_line(text: Column, number: Column | int) -> Column:
    """Line ``number``, counted from 1 and stripped; '' outside of the text."""
    n = F.lit(number) if isinstance(number, int) else number
    return F.when(n < 1, F.lit("")).otherwise(F.coalesce(strip(F.try_element_at(lines(text), F.greatest(n, F.lit(1)))), F.lit("")))


def extract_body(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, both included; '' for a span that is empty or starts before line 1."""
    span = F.slice(lines(text), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))
    return F.when((start < 1) | (end < start), F.lit("")).otherwise(F.array_join(span, "\n"))


def document_string(name: Column, signature: Column, docstring: Column) -> Column:
    """What is embedded for a symbol: its name, signature and docstring, blanks left out."""
    some = lambda c: F.when(strip(c) != "", c)
    return F.concat_ws("  ", name, some(signature), some(docstring))


def display(kind: Column, name: Column, file: Column, line: Column) -> Column:
    where = F.when(line != 0, F.concat_ws(":", file, line.cast("string"))).otherwise(file)
    return F.concat(kind, F.lit(" "), name, F.lit("  ("), where, F.lit(")"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The extension with its dot, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def language_of(path: Column, language: Column | None = None) -> Column:
    """``language`` where it is given, else the language of the path's extension, else ''."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF_EXTENSION.items() for x in kv])
    by_path = F.coalesce(F.try_element_at(table, suffix(path)), F.lit(""))
    return by_path if language is None else F.coalesce(F.when(language != "", language), by_path)


def preview(doc: Column, most: int = 100) -> Column:
    return F.translate(F.substring(doc, 1, most), "\n", " ")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def radius(in_degree: Column) -> Column:
    return F.least(F.lit(5.0) + F.sqrt(in_degree) * F.lit(2.2), F.lit(28.0))


def plural(n: Column, one: str, some: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(some)))


#: Messages of the look-ups, by operator; {n} results, {x} the subject.
MESSAGES = {
    "callers": "{n} caller(s) of '{x}'",
    "callees": "'{x}' calls {n} symbol(s)",
    "subclasses": "{n} subclass(es) of '{x}'",
    "superclasses": "'{x}' inherits from {n} class(es)",
    "implementors": "{n} implementor(s) of '{x}'",
    "imports_of": "'{x}' imports {n} module(s)",
    "find_symbol": "Found {n} symbol(s) named '{x}'",
}


def message(operator: str, n: Column, subject: Column) -> Column:
    parts = re.split(r"(\{[nx]\})", MESSAGES[operator])
    return F.concat(*[{"{n}": n.cast("string"), "{x}": subject}.get(p, F.lit(p)) for p in parts if p])


def glob_regex(glob: str) -> str:
    """The regular expression of a shell pattern; ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] == "!"))
            if end < 0:
                out += r"\["
            else:
                inner = glob[i:end].replace("\\", "\\\\").replace("[", r"\[").replace("&&", r"&\&")
                out += "[" + ("^" + inner[1:] if inner[:1] == "!" else "\\" + inner if inner[:1] == "^" else inner) + "]"
                i = end + 1
        else:
            out += re.escape(c)
    return out


def excluded(path: Column, globs: Iterable[str], defaults: bool = True) -> Column:
    """Whether a pattern fits the whole path or its last part.

    The default patterns also apply at the root, where no slash comes before.
    """
    pats = list(globs)
    if defaults:
        pats += [*DEFAULT_EXCLUDES, *(g[3:] for g in DEFAULT_EXCLUDES)]
    if not pats:
        return F.lit(False)
    joined = "(?s)^(?:" + "|".join(dict.fromkeys(map(glob_regex, pats))) + ")$"
    return path.rlike(joined) | base_name(path).rlike(joined)
