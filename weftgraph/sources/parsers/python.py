"""Python by its own syntax tree; a file with a syntax error is read by indentation instead."""

from __future__ import annotations

import ast
import re

from ... import schema as S
from .base import Rows, register

#: Built-in names that are no calls of the project's symbols.
BUILTINS = frozenset(
    "abs all any bin bool bytes callable chr classmethod compile delattr dict dir divmod enumerate eval exec filter float format getattr globals hasattr hash hex id "
    "input int isinstance issubclass iter len list locals map max min next oct open ord pow print property range repr reversed round set setattr sorted staticmethod "
    "str sum super tuple type vars zip __import__ Ellipsis NotImplemented".split()
)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _module(file: str) -> str:
    return re.sub(r"\.py$", "", file).replace("/", ".")


def _doc(node: ast.AST) -> str:
    return (ast.get_docstring(node, clean=False) or "").strip()


def _name(e: ast.expr) -> str | None:
    return e.id if isinstance(e, ast.Name) else e.attr if isinstance(e, ast.Attribute) else None


def parse(rows: Rows, options: dict) -> None:
    try:
        tree = ast.parse(rows.source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        rows.errors.append(f"{rows.file}: {type(e).__name__}: {e}")
        _by_indent(rows)
        return
    classes, functions, calls, imports = [], [], [], []

    todo: list[tuple[ast.AST, tuple[ast.AST, ...]]] = [(tree, ())]
    while todo:  # a stack of its own: expressions may be nested deeper than calls can be
        node, around = todo.pop()
        if isinstance(node, ast.ClassDef):
            classes.append((node, around))
        elif isinstance(node, _DEFS):
            functions.append((node, around))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            imports.append(node)
        elif isinstance(node, ast.Call) and (name := _name(node.func)):
            calls.append((name, around))
        scope = (*around, node) if isinstance(node, (ast.ClassDef, *_DEFS)) else around
        held = {id(x) for f in ("decorator_list", "bases", "keywords") for x in getattr(node, f, [])} if scope is not around else ()
        todo += reversed([(child, around if id(child) in held else scope) for child in ast.iter_child_nodes(node)])
    ids: dict[ast.AST, str] = {}
    for c, around in classes:
        outer = [a.name for a in around if isinstance(a, ast.ClassDef)]
        ids[c] = rows.node(S.CLASS, rows.id(c.name), c.name, ".".join((_module(rows.file), *outer[-1:], c.name)), c.lineno, c.end_lineno, _doc(c))
        for b in c.bases:
            if base := _name(b):
                rows.edge(ids[c], rows.id(base), S.INHERITS)
    for f, around in functions:
        owner = around[-1] if around and isinstance(around[-1], ast.ClassDef) else None
        path = (owner.name, f.name) if owner else (f.name,)
        marks = tuple(ast.unparse(d).split("(")[0] for d in f.decorator_list)
        ids[f] = rows.node(S.METHOD if owner else S.FUNCTION, rows.id(*path), f.name, ".".join((_module(rows.file), *path)), f.lineno, f.end_lineno, _doc(f), isinstance(f, ast.AsyncFunctionDef), marks)
        if owner:
            rows.edge(ids[owner], ids[f], S.CONTAINS)
    for i in imports:
        if isinstance(i, ast.Import):
            for a in i.names:
                if a.asname is None or options.get("all_imports"):
                    rows.edge(rows.file, S.EXTERNAL_PREFIX + a.name, S.IMPORTS)
        elif i.module and not i.level and (i.names[0].name != "*" or options.get("all_imports")):
            rows.edge(rows.file, S.EXTERNAL_PREFIX + i.module, S.IMPORTS)
    for name, around in calls:
        if name not in BUILTINS:
            caller = next((ids[a] for a in reversed(around) if isinstance(a, _DEFS)), rows.file)
            rows.edge(caller, rows.local_target(name), S.CALLS)


_HEAD = re.compile(r"^([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)[ \t]*(\([^)]*\))?")


def _by_indent(rows: Rows) -> None:
    """Classes, functions, bases and plain imports of a file that does not parse."""
    found = []
    for n, text in enumerate(rows.lines, 1):
        if m := _HEAD.match(text):
            depth, end = len(m[1].expandtabs()), n
            for k in range(n, len(rows.lines)):
                following = rows.lines[k]
                if following.strip() and len(following[: len(following) - len(following.lstrip())].expandtabs()) <= depth:
                    break
                end = k + 1 if following.strip() else end
            found.append((n, end, depth, m[2], m[3], m[4] or ""))
        elif m := re.match(r"\s*(?:from\s+([\w.]+)\s+import\s+[^*\s]|import\s+([\w.]+)\s*$)", text):
            if not (m[1] or "").startswith("."):
                rows.edge(rows.file, S.EXTERNAL_PREFIX + (m[1] or m[2]), S.IMPORTS)
    for n, end, _, what, name, bases in found:
        if what == "class":
            rows.node(S.CLASS, rows.id(name), name, f"{_module(rows.file)}.{name}", n, end)
            for b in re.findall(r"(?:[\w.]*\.)?(\w+)\s*(?=[,)])", bases):
                rows.edge(rows.id(name), rows.id(b), S.INHERITS)
    for n, end, depth, what, name, _ in found:
        if what != "class":
            around = [f for f in found if f[0] < n <= f[1] and f[2] < depth]
            owner = around[-1] if around and around[-1][3] == "class" else None
            path = (owner[4], name) if owner else (name,)
            rows.node(S.METHOD if owner else S.FUNCTION, rows.id(*path), name, ".".join((_module(rows.file), *path)), n, end, "", what != "def")
            if owner:
                rows.edge(rows.id(owner[4]), rows.id(*path), S.CONTAINS)


register("python", (".py",), parse)
