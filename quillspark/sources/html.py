"""HTML pages: text without excluded subtrees, links, and the records of an item page.

The pages are parsed by the standard library's parser within Arrow batches; a page is handled by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

SKIPPED = {"script", "style", "nav", "footer", "template", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "pre", "table", "tr", "br", "header", "details", "summary"}


class Node:
    """An element of a page's tree; text is kept as strings among its children."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def has(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def text(self, skip: Callable[[Node], bool] = lambda n: n.tag in SKIPPED) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif not skip(n):
                if n.tag in _BLOCK:
                    out.append("\n")
                    stack.append("\n")
                stack.extend(reversed(n.children))
        return block_text("".join(out))


def block_text(text: str) -> str:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\r", "")))
    return text.strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def page_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, text of the article (or the body)."""
    ship(pages.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("title", pa.string()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = tree(h)
                by = {}
                for n in t.walk():
                    by.setdefault(n.tag, n)
                main = by.get("article") or by.get("main") or by.get("body") or t
                rows.append((k, by["title"].text() if "title" in by else None, main.text()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return pages.select(F.col(key), F.col(html)).mapInArrow(run, f"{key} long, title string, text string")


def hrefs(html: Column) -> Column:
    """Distinct relative links to HTML pages."""
    found = F.regexp_extract_all(html, F.lit(r'href="([^"#?]+)'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike("^[a-z][a-z0-9+.-]*:|^//")))


def file_kind(path: Column) -> Column:
    """struct<kind, name> of a documentation file: kind.Name.html; index and all pages are modules, indexes of functions nothing."""
    base = F.element_at(F.split(path, "/"), -1)
    rx = r"(?i)^([a-z_]+)\.(.+?)(?:-\d+)?\.html$"
    up = F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)
    return (
        F.when(base.isin("index.html", "all.html"), F.struct(F.lit("module").alias("kind"), up.alias("name")))
        .when(base.rlike(rx) & ~F.regexp_extract(base, rx, 1).isin("fnindex", "traitindex"), F.struct(F.regexp_extract(base, rx, 1).alias("kind"), F.regexp_extract(base, rx, 2).alias("name")))
    )


def indexable(path: Column, size: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return ~base.isin("all.html", "help.html", "settings.html") & ~((base == "index.html") & (size > 400 * 1024)) & ~path.rlike(r"(^|/)src/|\.lock/")


# Prefixes of section ids and the kinds they stand for.
SECTION_KINDS = {
    "method": "method", "tymethod": "method", "structmethod": "method", "structassocfn": "method", "associatedconstant": "associated_const",
    "structassociatedconstant": "associated_const", "tyassociatedconst": "associated_const", "assocconst": "associated_const", "associatedtype": "associated_type",
    "structassociatedtype": "associated_type", "tyassociatedtype": "associated_type", "structfield": "field", "field": "field", "variant": "variant",
}


def _doc_after(n: Node, hops: int = 6) -> str:
    """The doc block within an element, or the first one that follows it or one of its ancestors nearby."""
    for m in n.walk():
        if m is not n and m.has("docblock"):
            return m.text()
    for _ in range(hops):
        p = n.parent
        if p is None:
            break
        at = next(i for i, c in enumerate(p.children) if c is n)
        for c in p.children[at + 1 :]:
            if isinstance(c, Node):
                if c.has("docblock"):
                    return c.text()
                if "id" in c.attrs or c.tag in ("section", "h2", "h3", "h4"):
                    return ""
        n = p
    return ""


def _owner(n: Node) -> tuple[str | None, str | None]:
    """Trait and owner of the nearest impl header around or before an element."""
    while n is not None:
        for c in ([n] if n.attrs.get("id", "").startswith("impl-") else []) + [x for x in (n.parent.children if n.parent else []) if isinstance(x, Node) and x.attrs.get("id", "").startswith("impl-")]:
            head = next((m.text() for m in c.walk() if m.tag in ("h3", "h4")), c.text())
            m = re.match(r"impl(?:<[^>]*>)?\s+(?:(.+?)\s+for\s+)?(.+)", head.replace("\n", " "))
            if m:
                strip = lambda x: re.split(r"\bwhere\b|<", x)[0].strip() or None if x else None
                return strip(m[1]), strip(m[2])
        n = n.parent
    return None, None


def item_records(path: str, html: str) -> list[dict]:
    """Records of an item page: the item, then its members by section id, with docs, signature, owner and examples."""
    base = path.rsplit("/", 1)[-1]
    m = re.match(r"(?i)^([a-z_]+)\.(.+?)(?:-\d+)?\.html$", base)
    kind, name = (m[1], m[2]) if m else ("module", path.split("/")[-2] if "/" in path else base)
    if kind in ("fnindex", "traitindex"):
        return []
    module = "::".join(path.split("/")[:-1])
    root = tree(html)
    nodes = list(root.walk())
    decl = next((n.text(lambda x: False) for n in nodes if n.tag == "pre" and n.has("item-decl")), "")
    top = next((n.text() for n in nodes if n.has("docblock")), "")
    out = [{"kind": kind, "name": name, "full_path": f"{module}::{name}", "module": module, "owner": None, "signature": decl, "docs": top, "examples": 0}]
    for n in nodes:
        prefix, _, rest = n.attrs.get("id", "").partition(".")
        if rest and prefix in SECTION_KINDS:
            member = rest.split("-")[0]
            trait, owner = _owner(n)
            head = next((x.text() for x in n.walk() if x.has("code-header") or x.tag in ("h3", "h4", "code")), n.text())
            out.append({"kind": SECTION_KINDS[prefix], "name": member, "full_path": f"{module}::{name}::{member}", "module": module, "owner": owner or name, "signature": head, "docs": _doc_after(n), "examples": 0})
    for n in nodes:
        if n.has("example-wrap") or (n.tag == "pre" and n.has("rust") and not n.has("item-decl")):
            out[0]["examples"] += 1
    return out


def extract_items(pages: DataFrame, path: str, html: str) -> DataFrame:
    ship(pages.sparkSession)
    schema = pa.schema([(c, pa.string()) for c in ("kind", "name", "full_path", "module", "owner", "signature", "docs")] + [("examples", pa.int64())])

    def run(batches):
        for b in batches:
            rows = [r for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in item_records(p or "", h or "")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select(F.col(path), F.col(html)).mapInArrow(run, "kind string, name string, full_path string, module string, owner string, signature string, docs string, examples long")
