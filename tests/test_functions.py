"""Scalar functions on single rows."""

from __future__ import annotations

import fnmatch

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "a\nb", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\n\n", None])
def test_lines(spark, text):
    assert one(spark, scalar.lines(F.lit(text).cast("string"))) == (text or "").splitlines()


def test_bodies(spark):
    t = F.lit("a\n b \nc\nd")
    assert one(spark, scalar.cap_body(t, 2)) == "a\n b \n# ... (2 more lines)"
    assert one(spark, scalar.cap_body(t, 4)) == one(spark, scalar.cap_body(t, 0)) == "a\n b \nc\nd"
    assert one(spark, scalar.get_line(t, 2)) == "b" and one(spark, scalar.get_line(t, 9)) == one(spark, scalar.get_line(t, 0)) == ""
    assert one(spark, scalar.extract_body(t, F.lit(2), F.lit(3))) == " b \nc" and one(spark, scalar.extract_body(t, F.lit(3), F.lit(2))) == one(spark, scalar.extract_body(t, F.lit(0), F.lit(2))) == ""


@pytest.mark.parametrize("text", ["\tindented\t", "\u3000wide\xa0", "\x1c\x85 x y \u2029", "", " \n "])
def test_all_white_space_is_stripped(spark, text):
    assert one(spark, scalar.strip(F.lit(text))) == text.strip()
    assert one(spark, scalar.get_line(F.lit("a\n\t b \t\nc"), 2)) == "b" and one(spark, scalar.document_string(F.lit("n"), F.lit("\t"), F.lit("d"))) == "n  d"


def test_names(spark):
    assert one(spark, scalar.node_id(F.lit("f"), F.lit("C"), F.lit("m"))) == "f::C::m"
    assert one(spark, scalar.external_id(F.lit("os"))) == "ext::os" and one(spark, scalar.external_id(F.lit("os"), F.lit("path"))) == "ext::os::path"
    assert one(spark, scalar.relative_path(F.lit("/r/a/b.py"), "/r/")) == "a/b.py" and one(spark, scalar.relative_path(F.lit("/other/b.py"), "/r")) == "/other/b.py"
    assert one(spark, scalar.suffix(F.lit("a.b/c.PY"))) == ".py" and one(spark, scalar.suffix(F.lit("a.b/.hidden"))) == "" and one(spark, scalar.base_name(F.lit("x"))) == "x"
    assert one(spark, scalar.language_of(F.lit("a/b.tsx"))) == "typescript" and one(spark, scalar.language_of(F.lit("a"), F.lit("go"))) == "go" and one(spark, scalar.language_of(F.lit("a"), F.lit(""))) == ""


def test_text(spark):
    doc = lambda s, d: one(spark, scalar.document_string(F.lit("n"), F.lit(s), F.lit(d)))
    assert doc("s", "d") == "n  s  d" and doc("", "d") == "n  d" and doc(" ", "") == "n"
    show = lambda line: one(spark, scalar.display(F.lit("class"), F.lit("N"), F.lit("f"), F.lit(line)))
    assert show(3) == "class N  (f:3)" and show(0) == "class N  (f)"
    assert one(spark, scalar.escape_html(F.lit('<a href="&">'))) == "&lt;a href=&quot;&amp;&quot;&gt;"
    assert one(spark, scalar.preview(F.lit("x\n" * 80))) == "x " * 50
    assert one(spark, scalar.radius(F.lit(0))) == 5.0 and one(spark, scalar.radius(F.lit(10000))) == 28.0


@pytest.mark.parametrize("glob", ["*.py", "src/*", "a?c", "[ab]*", "[!ab]*", "**/x/**", "a.b", "[", "[]a]", "a[", "x+(y)", "[^a]"])
@pytest.mark.parametrize("path", ["a.py", "src/a/b.py", "abc", "b", "c", "q/x/r", "x/r", "aXb", "[", "]", "a[", "x+(y)", "a.b", "^"])
def test_globs(glob, path):
    import re

    assert bool(re.fullmatch("(?s)" + scalar.glob_regex(glob), path)) == fnmatch.fnmatchcase(path, glob)


def test_excluded(spark):
    hit = lambda p, *g: one(spark, scalar.excluded(F.lit(p), g))
    assert hit("node_modules/a.js") and hit("p/node_modules/q/a.js") and hit("x.min.js") and not hit("src/a.js")
    assert hit("deep/in/test_x.py", "test_*") and not hit("deep/in/x.py", "test_*")
    assert not one(spark, scalar.excluded(F.lit("dist/x"), [], defaults=False))
