"""The command line: index, query, viz, info, config."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from .config import Config
from .engine import Index
from .operators import exports
from .session import local_session


class _Handler(BaseHTTPRequestHandler):
    """The page, and its data as JSON: /api/graph, /api/stats, /api/query?q=..., /api/node/<id>."""

    def __init__(self, index: Index, page: str, *args) -> None:
        self.index, self.page = index, page
        super().__init__(*args)

    def _send(self, body: str, kind: str = "application/json", status: int = 200) -> None:
        data = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", f"{kind}; charset=utf-8")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:  # noqa: N802
        url = urlparse(self.path)
        ask = {k: v[0] for k, v in parse_qs(url.query).items()}
        if url.path == "/":
            self._send(self.page, "text/html")
        elif url.path == "/api/graph":
            self._send(json.dumps(exports.export_elements(self.index.graph)))
        elif url.path == "/api/stats":
            self._send(json.dumps({**self.index.stats(), "project": self.index.root}))
        elif url.path == "/api/query" and ask.get("q"):
            limit = min(50, max(1, int(ask["limit"]) if ask.get("limit", "").isdigit() else 10))
            self._send(json.dumps(self.index.query(ask["q"], limit, ask.get("explain") == "true")))
        elif url.path.startswith("/api/node/") and (node := self.index.node(unquote(url.path[len("/api/node/") :]))):
            self._send(json.dumps(node))
        else:
            self._send('{"detail": "not found"}', status=404)

    def log_message(self, *args) -> None:
        pass


LOCAL, PORT = "127.0.0.1", 7331


def serve(index: Index, host: str = LOCAL, port: int = PORT) -> HTTPServer:
    """A server bound to the address; ``serve_forever`` starts it."""
    return HTTPServer((host, port), partial(_Handler, index, index.html()))


_SWITCH = {"action": "store_true"}
#: The flags of each command, with their short names.
_FLAGS: dict[str, dict[str, dict]] = {
    "index": {"-e --exclude": {"action": "append", "default": []}, "-f --fresh": _SWITCH, "--max-body-lines": {"type": int}},
    "query": {"-n --limit": {"type": int, "default": 10}, "--explain": _SWITCH},
    "viz": {"-o --out": {"default": "graph.html"}, "-s --serve": _SWITCH, "--host": {"default": LOCAL}, "-p --port": {"type": int, "default": PORT}},
    "info": {},
    "config": {},
}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftgraph", description=__doc__)
    p.add_argument("--cpus", type=int, default=8)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "query", "viz", "info", "config"):
        s = sub.add_parser(name)
        s.add_argument("root", nargs="?", default=".")
        if name == "query":
            s.add_argument("text")
        for flag, more in _FLAGS[name].items():
            s.add_argument(*flag.split(), **more)
    a = p.parse_args(args)
    given = {"exclude": tuple(a.exclude) or None, "max_body_lines": a.max_body_lines} if a.command == "index" else {}
    config = Config.load(a.root, **given)
    if a.command == "config":
        print(json.dumps({**asdict(config), "model_key": "set" if config.model_key else ""}, indent=2))
        return 0
    index = Index(local_session(a.cpus), a.root, config)
    if a.command == "index":
        report = index.build(a.fresh)
        print(json.dumps(asdict(report) | {"languages": sorted(index.stats()["by_language"])}))
        for e in report.errors:
            print(e, file=sys.stderr)
        return 0
    if not index.exists():
        print("no index here; run the index command first", file=sys.stderr)
        return 1
    if a.command == "query":
        got = index.query(a.text, a.limit, a.explain)
        for h in got["hits"]:
            doc = (h["docstring"] or "")[:100].replace("\n", " ")
            print(f"{h['distance']:.4f}  {h['kind']} {h['name']}  ({h['file']}{':' + str(h['line']) if h['line'] else ''})  {doc}")
        if got["explanation"]:
            print(got["explanation"])
    elif a.command == "viz":
        print(index.viz(a.out))
        if a.serve:
            serve(index, a.host, a.port).serve_forever()
    else:
        print(json.dumps(index.stats() | {"vectors": index.vector_count(), "vector_bytes": index.vector_bytes()}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
