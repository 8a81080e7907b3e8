"""Each parser on a small file of its language, written for these tests."""

from __future__ import annotations

from weftgraph.sources.parsers import parse_source, parser_for, supported_extensions, supported_languages

PY = '''import os
import numpy as np
from json import dumps, loads as ld
from . import sibling


def outer(x):
    """Adds one."""
    def helper(y):
        return y + 1
    print(x)
    return helper(x)


@cache(size=3)
@mod.wrap
async def fetch(url):
    return await outer(url)


class Base:
    """A base."""

    def run(self):
        return self.step()

    def step(self):
        return dumps({})


class Child(Base, pkg.Mixin):
    class Inner(Other):
        def deep(self):
            pass

    def run(self):
        return super().run()


fetch("x")
'''

JS = """import fs from 'fs';
import { a, b } from "./lib.js";
const path = require('path');

/**
 * Greets.
 */
function greet(name) {
  return `hi ${name} { not a brace`; // function fake() {}
}

async function load() { return greet("x {"); }

const twice = (x) => { return x * 2; };
const once = x => x + 1;
const old = function (y) { return y; };

export class Animal {
  constructor(name) { this.name = name; }
  speak() {
    if (this.name) { return greet(this.name); }
    return null;
  }
}

class Dog extends Animal {
  /* Barks. */
  static async bark(n = 1) { return n; }
}
"""

TS = """import type { T } from './types';
interface Shape { area(): number; }
enum Color { Red, Green }
abstract class Box<T> extends Base implements Shape, Named<T> {
  private size: number = 3;
  area(): number { return this.size; }
}
export const f = async (x: number): Promise<number> => { return x; };
"""

GO = """package main

import "fmt"
import (
    "os"
    str "strings"
)

// Speaker can
// speak.
type Speaker interface {
    Speak() string
}

// Dog is one.
type Dog struct {
    Name string
    inner struct { x int }
}

type (
    Cat struct { n int }
)

// Speak says it.
func (dog *Dog) Speak() string { return "{" + dog.Name }

func (c Cat) Len() int { return c.n }

func main() {
    d := Dog{}
    d.Speak()
}

func Map[T any](xs []T, f func(T) T) []T {
    return xs
}
"""

RUST = """use std::fmt;
use std::collections::{HashMap, HashSet};

/// A point.
pub struct Point { x: i32 }

/// Lost.
#[derive(Debug)]
enum Kind { A, B }

struct Unit;
union Bits { a: u32, b: f32 }

pub trait Shape {
    fn area(&self) -> f64;
    fn name(&self) -> String { "{".to_string() }
}

impl Shape for Point {
    fn area(&self) -> f64 { 0.0 }
}

impl fmt::Display for Point {
    fn fmt<'a>(&'a self, out: &'a mut Out<'_>) -> Written { out.add("x", '}') }
}

impl<T> Holder<T> {
    pub fn get(&self) -> char { '{' }
}

/// Runs.
/// Well.
pub async fn run(x: impl Shape) -> i32 { 1 }
"""

JAVA = """package a.b;
import java.util.List;
import java.util.*;
import static java.lang.Math.max;

/**
 * A thing.
 */
public interface Walker {
    void walk(int n);
    default int legs() { return 4; }
}

enum Size { SMALL, LARGE; int rank() { return 1; } }

/** Dog. */
@Deprecated(since = "1")
public class Dog extends Animal<String> implements Walker, Comparable<Dog> {
    private final String name = String.valueOf("class X {");
    private int[] xs = new int[]{1, 2};

    public Dog(String name) { this.name = name; }
    public Dog() { this("x"); }

    /**
     * Walks.
     */
    @Override
    public void walk(int n) { if (n > 0) { walk(n - 1); } }

    static <T> List<T> of(T a) throws Exception { return null; }

    class Inner { void in() {} }
}
"""


def _nodes(path, text, **options):
    rows = parse_source(path, text, options)
    assert not rows.errors, rows.errors
    return {n["node_id"]: n for n in rows.nodes}, rows.edges


def test_registry():
    assert supported_extensions() == [".cjs", ".go", ".java", ".js", ".mjs", ".py", ".rs", ".ts", ".tsx"]
    assert supported_languages() == ["go", "java", "javascript", "python", "rust"]
    assert parser_for("a/B.PY")[0] == "python" and parser_for("x.txt") is None and parser_for("Makefile") is None


def test_python():
    n, e = _nodes("p/m.py", PY)
    assert n["p/m.py::outer"]["kind"] == "function" and n["p/m.py::outer"]["line"] == 7 and n["p/m.py::outer"]["docstring"] == "Adds one."
    assert n["p/m.py::helper"]["kind"] == "function" and n["p/m.py::helper"]["signature"] == "def helper(y):"
    f = n["p/m.py::fetch"]
    assert f["is_async"] and f["decorators"] == ["cache", "mod.wrap"] and f["line"] == 17
    assert n["p/m.py::Base::run"]["kind"] == "method" and n["p/m.py::Base::run"]["qualified"] == "p.m.Base.run"
    assert n["p/m.py::Inner"]["qualified"] == "p.m.Child.Inner"
    assert ("p/m.py::Child", "p/m.py::Base", "INHERITS") in e and ("p/m.py::Child", "p/m.py::Mixin", "INHERITS") in e
    assert ("p/m.py::Inner", "p/m.py::Other", "INHERITS") in e and ("p/m.py::Child", "p/m.py::Other", "INHERITS") not in e
    assert ("p/m.py::Base", "p/m.py::Base::run", "CONTAINS") in e and ("p/m.py::Inner", "p/m.py::Inner::deep", "CONTAINS") in e
    assert {t for _, t, k in e if k == "IMPORTS"} == {"ext::os", "ext::json"}
    calls = [(s, t) for s, t, k in e if k == "CALLS"]
    assert ("p/m.py::outer", "p/m.py::helper") in calls and ("p/m.py", "p/m.py::fetch") in calls
    assert ("p/m.py::Base::run", "p/m.py::Base::step") in calls and ("p/m.py::Base::step", "ext::__unresolved__::dumps") in calls
    assert not any(t.endswith("print") for _, t in calls)


def test_python_imports_option_and_body_cap():
    n, e = _nodes("m.py", PY, all_imports=True, max_body_lines=1)
    assert ("m.py", "ext::numpy", "IMPORTS") in e
    assert n["m.py::outer"]["body"] == "def outer(x):\n# ... (5 more lines)"


def test_python_syntax_error_still_gives_symbols():
    rows = parse_source("bad.py", "import os\nclass A(B):\n    def f(self):\n        return (\n\ndef g():\n    pass\n")
    assert len(rows.errors) == 1
    assert {n["node_id"]: n["kind"] for n in rows.nodes} == {"bad.py::A": "class", "bad.py::A::f": "method", "bad.py::g": "function"}
    assert ("bad.py::A", "bad.py::B", "INHERITS") in rows.edges and ("bad.py", "ext::os", "IMPORTS") in rows.edges


def test_javascript():
    n, e = _nodes("s/app.js", JS)
    kinds = {i.removeprefix("s/app.js::"): x["kind"] for i, x in n.items()}
    assert kinds == {
        "Animal": "class", "Dog": "class", "Animal::constructor": "method", "Animal::speak": "method", "Dog::bark": "method",
        "greet": "function", "load": "function", "twice": "function", "once": "function", "old": "function",
    }
    assert n["s/app.js::greet"]["line"] == 8 and n["s/app.js::greet"]["end_line"] == 10 and n["s/app.js::greet"]["docstring"] == "/**\n* Greets.\n*/"
    assert n["s/app.js::Dog::bark"]["docstring"] == "/* Barks. */" and n["s/app.js::Animal::speak"]["line"] == 20 and n["s/app.js::Animal::speak"]["end_line"] == 23
    assert ("s/app.js::Dog", "s/app.js::Animal", "INHERITS") in e and ("s/app.js::Animal", "s/app.js::Animal::speak", "CONTAINS") in e
    assert {t for _, t, k in e if k == "IMPORTS"} == {"ext::fs", "ext::./lib.js", "ext::path"}
    assert not any(k == "CALLS" for _, _, k in e)


def test_javascript_calls_option():
    _, e = _nodes("app.js", JS, emit_calls=True)
    calls = {(s, t) for s, t, k in e if k == "CALLS"}
    assert ("app.js::load", "app.js::greet") in calls and ("app.js::Animal::speak", "app.js::greet") in calls


def test_typescript():
    n, e = _nodes("b.ts", TS)
    assert {i: (x["kind"], x["language"]) for i, x in n.items()} == {
        "b.ts::Box": ("class", "typescript"), "b.ts::Box::area": ("method", "typescript"), "b.ts::Shape": ("interface", "typescript"),
        "b.ts::Color": ("enum", "typescript"), "b.ts::f": ("function", "typescript"),
    }
    assert ("b.ts::Box", "b.ts::Base", "INHERITS") in e
    assert {t for s, t, k in e if k == "IMPLEMENTS"} == {"b.ts::Shape", "b.ts::Named"} and ("b.ts", "ext::./types", "IMPORTS") in e


def test_go():
    n, e = _nodes("m.go", GO)
    assert {i.removeprefix("m.go::"): x["kind"] for i, x in n.items()} == {
        "Speaker": "interface", "Dog": "struct", "Cat": "struct", "Dog::Speak": "method", "Cat::Len": "method", "main": "function", "Map": "function",
    }
    assert n["m.go::Speaker"]["docstring"] == "Speaker can speak." and n["m.go::Dog::Speak"]["qualified"] == "m.go.Dog.Speak"
    assert ("m.go::Dog", "m.go::Dog::Speak", "CONTAINS") in e
    assert [t for _, t, k in e if k == "IMPORTS"] == ["ext::fmt", "ext::os", "ext::strings"]
    assert n["m.go::main"]["end_line"] == 33


def test_rust():
    n, e = _nodes("l.rs", RUST)
    assert {i.removeprefix("l.rs::"): x["kind"] for i, x in n.items()} == {
        "Point": "struct", "Kind": "enum", "Unit": "struct", "Bits": "struct", "Shape": "trait", "name": "function", "Point::area": "method",
        "Point::fmt": "method", "Holder::get": "method", "run": "function",
    }
    assert n["l.rs::Point"]["docstring"] == "A point." and n["l.rs::Kind"]["docstring"] == "" and n["l.rs::run"]["docstring"] == "Runs. Well."
    assert ("l.rs::Point", "l.rs::Shape", "IMPLEMENTS") in e and ("l.rs::Point", "l.rs::fmt::Display", "IMPLEMENTS") in e
    assert {t for _, t, k in e if k == "IMPORTS"} == {"ext::std::fmt", "ext::std::collections::{HashMap, HashSet}"}


def test_java():
    n, e = _nodes("D.java", JAVA)
    assert {i.removeprefix("D.java::"): x["kind"] for i, x in n.items()} == {
        "Dog": "class", "Inner": "class", "Walker": "interface", "Size": "enum", "Walker::walk": "method", "Walker::legs": "method",
        "Dog::Dog": "method", "Dog::Dog_23": "method", "Dog::walk": "method", "Dog::of": "method", "Inner::in": "method",
    }
    assert n["D.java::Dog"]["docstring"] == "/** Dog. */" and n["D.java::Dog"]["signature"].startswith("@Deprecated")
    assert n["D.java::Dog::walk"]["docstring"] == "/**\n* Walks.\n*/"
    assert {t for s, t, k in e if k == "IMPLEMENTS"} == {"D.java::Walker", "D.java::Comparable"} and ("D.java::Dog", "D.java::Animal", "INHERITS") in e
    assert {t for _, t, k in e if k == "IMPORTS"} == {"ext::java.util.List", "ext::java.util", "ext::java.lang.Math.max"}


def test_odd_inputs():
    for ext in ("py", "js", "ts", "go", "rs", "java"):
        for text in ("", "\n\n", "{{{{", "}}}}((", '"unclosed', "/* open", "class", "func (", "impl<", "\x00\x01", "é" * 100):
            parse_source(f"x.{ext}", text)
    assert parse_source("x.py", None).errors and not parse_source("x.txt", "class A:").nodes


def test_python_deep_expressions():
    for n in (3_000, 300_000):  # the second is too deep for a syntax tree
        rows = parse_source("x.py", "import os\ndef f():\n    return " + "+".join(["1"] * n) + "\ndef g():\n    return f()\n")
        assert [t[3] for t in rows.tuples() if t[0] == "node"] and {t[2] for t in rows.tuples() if t[0] == "node"} == {"x.py::f", "x.py::g"}
    assert parse_source("x.py", "def f():\n    return " + "(" * 500 + ")" * 500 + "\n").errors
