"""Small sources of every language, for queries that have no table to read; the SQL lists what a reader finds in them."""

from __future__ import annotations

SOURCES = {
    "app/base.py": "import os\n\nclass Store:\n    def put(self, k):\n        return check(k)\n\ndef check(k):\n    return bool(k)\n",
    "app/main.py": "from app.base import Store\n\nclass Disk(Store):\n    async def flush(self):\n        check(1)\n",
    "web/ui.js": "import { h } from './h.js';\nclass View extends Base {\n  draw(x) { return h(x); }\n}\nconst go = (x) => x;\n",
    "web/model.ts": "interface Named { name: string }\nclass User implements Named {\n  rename(n: string): void { this.name = n; }\n}\n",
    "srv/main.go": 'package srv\n\nimport "net/http"\n\ntype Server struct { n int }\n\nfunc (s *Server) Run() error { return nil }\n\nfunc main() {}\n',
    "srv/lib.rs": "use std::io;\npub struct Pool { n: u8 }\ntrait Open { fn open(&self); }\nimpl Open for Pool {\n    fn open(&self) {}\n}\n",
    "srv/Job.java": "import java.util.List;\npublic class Job extends Task implements Runnable {\n  public void run() {}\n  void run(int n) {}\n}\n",
}

SYMBOLS = [
    ("app/base.py::Store", "class", 3, 5), ("app/base.py::Store::put", "method", 4, 5), ("app/base.py::check", "function", 7, 8),
    ("app/main.py::Disk", "class", 3, 5), ("app/main.py::Disk::flush", "method", 4, 5),
    ("web/ui.js::View", "class", 2, 4), ("web/ui.js::View::draw", "method", 3, 3), ("web/ui.js::go", "function", 5, 5),
    ("web/model.ts::Named", "interface", 1, 1), ("web/model.ts::User", "class", 2, 4), ("web/model.ts::User::rename", "method", 3, 3),
    ("srv/main.go::Server", "struct", 5, 5), ("srv/main.go::Server::Run", "method", 7, 7), ("srv/main.go::main", "function", 9, 9),
    ("srv/lib.rs::Pool", "struct", 2, 2), ("srv/lib.rs::Open", "trait", 3, 3), ("srv/lib.rs::Pool::open", "method", 5, 5),
    ("srv/Job.java::Job", "class", 2, 5), ("srv/Job.java::Job::run", "method", 3, 3), ("srv/Job.java::Job::run_4", "method", 4, 4),
]

LINKS = [
    ("app/base.py", "ext::os", "IMPORTS"), ("app/main.py", "ext::app.base", "IMPORTS"), ("app/base.py::Store", "app/base.py::Store::put", "CONTAINS"),
    ("app/main.py::Disk", "app/main.py::Disk::flush", "CONTAINS"), ("app/main.py::Disk", "app/main.py::Store", "INHERITS"),
    ("app/base.py::Store::put", "app/base.py::check", "CALLS"), ("app/main.py::Disk::flush", "app/base.py::check", "CALLS"),
    ("web/ui.js", "ext::./h.js", "IMPORTS"), ("web/ui.js::View", "web/ui.js::Base", "INHERITS"), ("web/ui.js::View", "web/ui.js::View::draw", "CONTAINS"),
    ("web/model.ts::User", "web/model.ts::Named", "IMPLEMENTS"), ("web/model.ts::User", "web/model.ts::User::rename", "CONTAINS"),
    ("srv/main.go", "ext::net/http", "IMPORTS"), ("srv/main.go::Server", "srv/main.go::Server::Run", "CONTAINS"),
    ("srv/lib.rs", "ext::std::io", "IMPORTS"), ("srv/lib.rs::Pool", "srv/lib.rs::Open", "IMPLEMENTS"), ("srv/lib.rs::Pool", "srv/lib.rs::Pool::open", "CONTAINS"),
    ("srv/Job.java", "ext::java.util.List", "IMPORTS"), ("srv/Job.java::Job", "srv/Job.java::Task", "INHERITS"), ("srv/Job.java::Job", "srv/Job.java::Runnable", "IMPLEMENTS"),
    ("srv/Job.java::Job", "srv/Job.java::Job::run", "CONTAINS"), ("srv/Job.java::Job", "srv/Job.java::Job::run_4", "CONTAINS"),
]


#: Further constructs, each with all that is told of it.
MORE = {
    "app/deco.py": "import functools\n\n@functools.cache\ndef slow(n):\n    \"\"\"Slow.\"\"\"\n    return n\n\nclass Late:\n    async def go(self):\n        pass\n",
    "app/deep.py": "def total():\n    return " + "+".join(["1"] * 3000) + "\n",
    "web/fn.js": "const fs = require('fs');\n\n/**\n * Adds.\n */\nfunction add(a, b) { return a; }\n",
    "srv/free.rs": "enum Mode { A, B }\nunion Raw { n: u8 }\n\n/// Runs it.\npub fn run() {}\n",
    "srv/Kinds.java": "/** Named. */\ninterface Named { }\nenum Color { RED, GREEN }\n",
    "srv/group.go": 'package srv\n\nimport (\n\t"fmt"\n\tio "io"\n)\n\n// Shape has an area.\ntype Shape interface { Area() int }\n',
    "bad/broken.py": "def ok():\n    return 1\n\ndef broken(:\n    pass\n",
}

DETAILS = [
    ("app/deco.py::slow", "function", "app.deco.slow", "def slow(n):", "Slow.", False, "functools.cache"), ("app/deco.py::Late", "class", "app.deco.Late", "class Late:", "", False, ""),
    ("app/deco.py::Late::go", "method", "app.deco.Late.go", "async def go(self):", "", True, ""), ("app/deep.py::total", "function", "app.deep.total", "def total():", "", False, ""),
    ("web/fn.js::add", "function", "web/fn.js.add", "function add(a, b) { return a; }", "/**\n* Adds.\n*/", False, ""), ("srv/free.rs::Mode", "enum", "srv/free.rs::Mode", "enum Mode { A, B }", "", False, ""),
    ("srv/free.rs::Raw", "struct", "srv/free.rs::Raw", "union Raw { n: u8 }", "", False, ""), ("srv/free.rs::run", "function", "srv/free.rs::run", "pub fn run() {}", "Runs it.", False, ""),
    ("srv/Kinds.java::Named", "interface", "srv/Kinds.java.Named", "interface Named { }", "/** Named. */", False, ""), ("srv/Kinds.java::Color", "enum", "srv/Kinds.java.Color", "enum Color { RED, GREEN }", "", False, ""),
    ("srv/group.go::Shape", "interface", "srv/group.go.Shape", "type Shape interface { Area() int }", "Shape has an area.", False, ""),
    ("bad/broken.py::ok", "function", "bad.broken.ok", "def ok():", "", False, ""), ("bad/broken.py::broken", "function", "bad.broken.broken", "def broken(:", "", False, ""),
]


def values(rows: list[tuple]) -> str:
    """Rows as the body of an SQL VALUES list."""
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
