"""Main-text extraction by host consensus.

First every page scores its containers: each run of text counts for its nearest container and by
half for the next one out, link text against it. The page's scores, in thousandths of their sum,
are votes for the containers' generalised paths (tags with their classes, digits as ``#``). Spark adds
the votes for each host; the path with most wins. Then every page is extracted again from the
containers on its host's winning path, and falls back on its own best container, then on its
whole body. Html is read twice and never shuffled unless there are very many hosts. Parsing takes time and memory in proportion
to the page, however deep its elements: open elements point to their parents' paths, and what is open is found by tag.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stash, tidy

#: Hosts and winning paths are broadcast up to so many bytes; beyond, pages and paths are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: A longer path is written as its last elements and a digest of the whole.
MAX_PATH = 1000

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<!--|<[!?][^<>]*+>""")
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("article aside body blockquote center details div dl fieldset figure footer form header main nav ol section table td ul".split())
_NOISE = frozenset("nav footer aside header form button select menu".split())
_BREAKS = _CONTAINERS | frozenset("p br hr li dt dd tr h1 h2 h3 h4 h5 h6 pre summary figcaption th address caption legend".split())
#: An opening tag ends these open elements, if they are not outside of the barrier.
_CLOSES = {
    **{t: (frozenset(["p"]), frozenset(["td", "th", "body"])) for t in "article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SPACE = re.compile(r"[ \t\r\n\f\xa0]+")
_DIGITS = re.compile(r"\d+")


class Page:
    """A page's text runs and its containers: ``(path, first run, end run, own score, parent, noise)``; a path is its last element's number."""

    def __init__(self, source: str) -> None:
        self.runs: list[str] = []
        self.noise: list[int] = []  # how deep in noise elements each run is
        self.containers: list[list] = []
        self.elements: list[tuple[int, str, int, str]] = []  # (parent or -1, name, length of path, digest if that is long)
        self._parse(source)

    def _element(self, parent: int, name: str) -> tuple[int, str, int, str]:
        if parent < 0:
            return parent, name, len(name), ""
        _, _, before, digest = self.elements[parent]
        n = before + 1 + len(name)
        if n > MAX_PATH:
            digest = md5(f"{digest or self.path(parent)}/{name}".encode("utf-8", "surrogatepass")).hexdigest()
        return parent, name, n, digest

    def path(self, k: int) -> str:
        """The path of element ``k``, from the root."""
        digest, names, held = self.elements[k][3], [], 0
        while k >= 0 and not (digest and held > MAX_PATH // 2):
            names.append(self.elements[k][1])
            held += len(names[-1]) + 1
            k = self.elements[k][0]
        path = "/".join(reversed(names))
        return f"{path[-MAX_PATH:]}#{digest}" if digest else path

    def _parse(self, s: str) -> None:
        stack: list[tuple[str, int, int]] = []  # (tag, element, container or -1)
        where: defaultdict[str, list[int]] = defaultdict(list)  # the places in the stack of each open tag
        numbers: dict[tuple[int, str], int] = {}
        inside, links, noise = [], 0, 0  # containers; depths of a and of noise elements
        runs, marks, boxes = self.runs, self.noise, self.containers
        at, n = 0, len(s)

        def text(a: int, b: int) -> None:
            t = s[a:b]
            if t and not t.isspace():
                t = _SPACE.sub(" ", entities.unescape(t) if "&" in t else t)
                size = len(t.strip())
                if inside:
                    boxes[inside[-1]][3] += -2 * size if links else 2 * size
                    if len(inside) > 1:
                        boxes[inside[-2]][3] += -size if links else size
                runs.append(t)
                marks.append(noise)
            elif t:
                runs.append(" ")
                marks.append(noise)

        def close(depth: int) -> None:
            """Closes all that is open from ``depth`` on."""
            nonlocal links, noise
            while len(stack) > depth:
                tag, _, box = stack.pop()
                where[tag].pop()
                if box >= 0:
                    boxes[box][2] = len(runs)
                    inside.pop()
                links -= tag == "a"
                noise -= tag in _NOISE
                if tag in _BREAKS:
                    runs.append("\n")
                    marks.append(noise)

        def innermost(tags) -> int:
            return max((w[-1] for t in tags if (w := where.get(t))), default=-1)

        while at < n:
            m = _TAG.search(s, at)
            if not m:
                text(at, n)
                break
            text(at, m.start())
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if m[0] == "<!--":
                    end = s.find("-->", at)
                    at = n if end < 0 else end + 3
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                depth = innermost((tag,))
                # a stray end tag does not close what is around it
                if depth >= 0 and (tag in _CONTAINERS or tag == "html" or depth >= innermost(("td", "body"))):
                    close(depth)
                continue
            if tag in _RAW:
                end = _RAW[tag].search(s, at)
                shut = -1 if not end else s.find(">", end.start())
                at = n if shut < 0 else shut + 1
                continue
            if tag in _CLOSES:
                ends, barrier = _CLOSES[tag]
                edge = innermost(barrier)
                outermost = (w[k] for t in ends if (w := where.get(t)) and (k := bisect_right(w, edge)) < len(w))
                close(min(outermost, default=len(stack)))
            if tag in _BREAKS:
                runs.append("\n")
                marks.append(noise)
            attributes = m[3] if m[2] else m[6]
            if tag in _VOID or attributes.endswith("/"):
                continue
            c = _CLASS.search(attributes)
            names = sorted({_DIGITS.sub("#", x) for x in (c[1] or c[2] or c[3] or "").split()}) if c else ()
            key = stack[-1][1] if stack else -1, ".".join([tag, *names])
            element = numbers.get(key)
            if element is None:
                element = numbers[key] = len(self.elements)
                self.elements.append(self._element(*key))
            box = -1
            if tag in _CONTAINERS:
                box = len(boxes)
                boxes.append([element, len(runs), len(runs), 0, inside[-1] if inside else -1, noise + (tag in _NOISE)])
                inside.append(box)
            links += tag == "a"
            noise += tag in _NOISE
            where[tag].append(len(stack))
            stack.append((tag, element, box))
        close(0)

    def scores(self) -> list[tuple[int, int]]:
        """(score, container) of those that score, best first; among equals the first on the page."""
        return sorted(((-b[3], k) for k, b in enumerate(self.containers) if b[3] > 0 and not b[5]), key=lambda x: x)

    def best(self) -> str | None:
        ranked = self.scores()
        return self.path(self.containers[ranked[0][1]][0]) if ranked else None

    def votes(self) -> dict[str, int]:
        """Thousandths of the page's score for each path."""
        by: Counter[int] = Counter()
        for s, k in self.scores():
            by[self.containers[k][0]] -= s
        total = sum(by.values())
        return {self.path(p): v for p, s in by.items() if (v := 1000 * s // total)}

    def text(self, path: str | None) -> str | None:
        """Text of the containers on ``path`` (all runs for None), without noise elements inside; None if there is none."""
        spans: list[tuple[int, int, int]] = []
        if path is None:
            spans = [(0, len(self.runs), 0)]
        else:
            known: dict[int, bool] = {}
            for p, a, b, _, _, noise in self.containers:
                if p not in known:
                    _, name, n, digest = self.elements[p]
                    known[p] = path.endswith("#" + digest) if digest else n == len(path) and path.endswith(name) and self.path(p) == path
                if known[p] and not (spans and a < spans[-1][1]):
                    spans.append((a, b, noise))
        if not spans:
            return None
        raw = "\n".join("".join(r for r, d in zip(self.runs[a:b], self.noise[a:b]) if d <= noise) for a, b, noise in spans)
        lines = (_SPACE.sub(" ", x).strip() for x in raw.split("\n"))
        return "\n".join(x for x in lines if x)


def host_of(url) -> F.Column:
    """The host of a URL in lower case, without user and port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@\s]+)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """``host``, ``path``, ``votes`` and ``n_pages`` from (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter[tuple[str, str]] = Counter()
            seen: Counter[tuple[str, str]] = Counter()
            for host, source in zip(b.column(0).to_pylist(), b.column(1)):
                for path, v in Page(source.as_py()).votes().items():
                    total[host, path] += v
                    seen[host, path] += 1
            hosts, paths = zip(*total) if total else ((), ())
            cols = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(total.values(), pa.int64()), pa.array(seen.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["host", "path", "votes", "n_pages"])

    known = pages.filter("host <> '' AND html IS NOT NULL").select("host", "html")
    rows = known.mapInArrow(run, "host string, path string, votes bigint, n_pages bigint")
    return rows.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n_pages").alias("n_pages"))


def winners(counted: DataFrame) -> DataFrame:
    """``host`` and its ``path`` of most votes; ties by pages, then by path."""
    best = F.min(F.struct((-F.col("votes")).alias("votes"), (-F.col("n_pages")).alias("pages"), "path")).alias("best")
    return counted.groupBy("host").agg(best).select("host", "best.path")


def extract(df: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row a page: ``page_id``, ``host``, ``path``, ``method``, ``text``, ``n_chars``.

    ``method`` is ``consensus`` where the page has containers with text on its host's winning path, ``own`` for the page's best
    container, ``body`` for the text outside of noise elements. A page whose url is null or has no host has host '',
    does not vote and uses its own. Pages may be long and nested deeply; a path of more than MAX_PATH characters is given by its end and a digest. Null html has null ``path``, ``method``, ``text`` and ``n_chars``; html without text gives ''. Repeated rows are
    kept, and each votes. Ids are integers, or strings of integers; any other string is an error. Other columns are not read.
    """
    pages = tidy(df).select(col(id_col).cast("bigint").alias("page_id"), host_of(col(url_col)).alias("host"), col(html_col).alias("html"))
    best = stash(winners(votes(pages)), "host-paths")
    if (best.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        best = F.broadcast(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for source, path in zip(b.column(2), b.column(3).to_pylist()):
                source = source.as_py()
                if source is None:
                    out.append((None,) * 4)
                    continue
                page = Page(source)
                for method, p in (("consensus", path), ("own", page.best()), ("body", None)):
                    if (p is not None or method == "body") and (t := page.text(p)):
                        out.append((p, method, t, len(t)))
                        break
                else:
                    out.append((None, "body", "", 0))
            paths, methods, texts, sizes = zip(*out) if out else ((),) * 4
            cols = [pa.array(paths, pa.string()), pa.array(methods, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["page_id", "host", "path", "method", "text", "n_chars"])

    joined = pages.join(best, "host", "left").select("page_id", "host", "html", "path")
    return joined.mapInArrow(run, "page_id bigint, host string, path string, method string, text string, n_chars bigint")
