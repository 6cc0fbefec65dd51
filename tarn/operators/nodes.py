"""Page nodes: order, duplicates, sections, look-ahead pairs, quality gates; and nodes out of HTML."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions import text as X
from tarn.session import ship_package

NODE = T.StructType([T.StructField(n, t) for n, t in (("node_type", T.StringType()), ("text", T.StringType()), ("node_level", T.IntegerType()), ("label", T.StringType()), ("value", T.StringType()), ("node_order", T.IntegerType()), ("origin", T.StringType()))])


def records(page_nodes: DataFrame) -> DataFrame:
    """The nodes, exact copies once, rows without an id left out."""
    return page_nodes.where("node_id is not null and page_id is not null").dropDuplicates(["node_id"])


def deduplicated(nodes: DataFrame) -> DataFrame:
    """The first node of each page, type and first 160 characters, numbered from 0 in page order."""
    key = Window.partitionBy("page_id", "node_type", F.substring("text", 1, 160)).orderBy("node_order", "node_id")
    page = Window.partitionBy("page_id").orderBy("node_order", "node_id")
    return nodes.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n").withColumn("position", F.row_number().over(page) - 1)


def with_heading(nodes: DataFrame) -> DataFrame:
    """Nodes with `heading`, the text of the last heading at or before them, and `section`, the number of headings so far."""
    page = Window.partitionBy("page_id").orderBy("node_order", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("node_type") == "heading"
    return nodes.withColumn("heading", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(page)).withColumn("section", F.sum(is_heading.cast("int")).over(page).cast("int"))


def look_ahead(nodes: DataFrame, reach: int = 8) -> DataFrame:
    """Label-like texts with the first value-like text among the next `reach` nodes of the page."""
    ahead = Window.partitionBy("page_id").orderBy("node_order", "node_id").rowsBetween(1, reach)
    short = F.length("text").between(1, 80)
    paired = nodes.withColumn("found", F.first(F.when(short & X.is_valueish(F.col("text")), F.col("text")), ignorenulls=True).over(ahead))
    return paired.where(short & X.is_labelish(F.col("text")) & F.col("found").isNotNull()).select("page_id", "node_id", F.col("text").alias("label_text"), F.col("found").alias("value_text"))


def quality(nodes: DataFrame, least_mean: float = 80.0) -> DataFrame:
    """(page_id, facts, mean_chars, kept): a page without facts whose texts are short on average is not kept."""
    g = nodes.where("text is not null").groupBy("page_id").agg(F.count_if(F.col("label").isNotNull()).alias("facts"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
    return g.withColumn("kept", (F.col("facts") > 0) | (F.col("mean_chars") >= least_mean))


# ---- nodes out of HTML ---------------------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript template nav footer aside form iframe svg header".split())
BLOCKS = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "tr": "table_row", **{f"h{i}": "heading" for i in range(1, 7)}}
_IMPLIED_END = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: Tags that end an open paragraph.
_ENDS_P = frozenset([*BLOCKS, "ul", "ol", "table", "div", "section", "article", "hr", "pre", "dl", *DROPPED]) - {"tr", "script", "style", "svg"}


class _Nodes(HTMLParser):
    """Collects typed nodes in document order. Open tags are held on a stack; a new p, li, tr or cell ends an open one."""

    def __init__(self, keep: set = frozenset()):
        super().__init__(convert_charrefs=True)
        self.keep = keep
        self.stack: list[str] = []
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.scripts: list[str] | None = None
        self.ld: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "script" and dict(attrs).get("type") == "application/ld+json":
            self.scripts = []
        if tag in VOID:
            if tag == "br" and self.open:
                self.open[-1]["parts"].append(" ")
            return
        if tag in _ENDS_P and "p" in self.stack:
            self._close("p")
        for old in _IMPLIED_END.get(tag, ()):
            if old in self.stack and not {"ul", "ol", "table"} & set(self.stack[len(self.stack) - self.stack[::-1].index(old) :]):
                self._close(old)
        # a wrapper with a grid of facts is read like any other; its end tag closes it by the same name
        self.stack.append(f"kept {tag}" if self.getpos() in self.keep else tag)
        if tag in BLOCKS and not DROPPED & set(self.stack):
            self.open.append({"tag": tag, "depth": len(self.stack), "parts": [], "cells": []})
        if tag in ("td", "th") and self.open and self.open[-1]["tag"] == "tr":
            self.open[-1]["cells"].append([])

    def _close(self, tag):
        if tag not in self.stack:
            tag = f"kept {tag}"
        if tag not in self.stack:
            return
        at = len(self.stack) - 1 - self.stack[::-1].index(tag)
        while self.open and self.open[-1]["depth"] > at:
            self._emit(self.open.pop())
        del self.stack[at:]

    def handle_endtag(self, tag):
        if tag == "script" and self.scripts is not None:
            self.ld.append("".join(self.scripts))
            self.scripts = None
        self._close(tag)

    def handle_data(self, data):
        if self.scripts is not None:
            self.scripts.append(data)
        if self.open and not DROPPED & set(self.stack):
            top = self.open[-1]
            (top["cells"][-1] if top["cells"] else top["parts"]).append(data)

    def _emit(self, block):
        clean = lambda parts: " ".join("".join(parts).split())
        kind = BLOCKS[block["tag"]]
        node = {"node_type": kind, "text": clean(block["parts"]), "node_level": int(block["tag"][1]) if kind == "heading" else None, "label": None, "value": None, "origin": "dom"}
        if block["cells"]:
            cells = [c for c in map(clean, block["cells"]) if c]
            if len(cells) > 1:
                node |= {"label": cells[0], "value": " | ".join(cells[1:]), "origin": "table"}
                node["text"] = f"{node['label']}: {node['value']}"
            else:
                node["text"] = " ".join(cells)
        if node["text"]:
            self.nodes.append(node)

    def close(self):
        super().close()
        while self.open:
            self._emit(self.open.pop())


# Words of the facts that a short text may state, and labels of a fact grid.
BADGE = re.compile(r"lock[-\s]?in|lockin|riskometer|benchmark|expense|exit\s*load|min\.?\s*for|minimum|\bnav\b|\baum\b|stamp\s*duty", re.I)
GRID_LABELS = ("TER", "Min SIP", "Riskometer", "Lock in", "AUM", "Entry Load", "Exit Load", "Benchmark", "Inception Date")
GRID_HITS, PILL_CHARS, LEAF_CHARS = 3, 60, 80
_CUT = re.compile(r"(\.{3}|…)\s*$")


class _Tree(HTMLParser):
    """The elements of a page as a tree of [tag, attributes, position, children]; texts are strings among the children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, None, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P and any(e[0] == "p" for e in self.open):
            self.handle_endtag("p")
        element = [tag, {k: v or "" for k, v in attrs}, self.getpos(), []]
        self.open[-1][3].append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.open[-1][3].append(data)


def _tree(html: str) -> list:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _text(element) -> str:
    parts, todo = [], [element]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo.extend(reversed(x[3]))
    return " ".join(" ".join(parts).split())


def _elements(root) -> Iterator[list]:
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(c for c in reversed(x[3]) if not isinstance(c, str))


def kept_wrappers(root) -> set:
    """The positions of wrappers that would be dropped as page furniture but hold a grid of facts."""
    return {e[2] for e in _elements(root) if e[0] in DROPPED and sum(label in _text(e) for label in GRID_LABELS) >= GRID_HITS}


def full_value(element) -> str:
    """The text of an element; if it is cut short, the longer text that its tooltip or title holds."""
    shown = " ".join("".join(c for c in element[3] if isinstance(c, str)).split())
    if _CUT.search(shown):
        begin = _CUT.sub("", shown).rstrip()
        hidden = [_text(e) for e in _elements(element) if e is not element and "tooltip" in e[1].get("class", "")] + [" ".join(element[1].get("title", "").split())]
        longer = [h for h in hidden if len(h) > len(begin) and h.startswith(begin)]
        if longer:
            return longer[0]
    return _text(element)


def page_badges(html: str) -> list[tuple[str, str]]:
    """(text, origin) of the short texts that state a fact by themselves, each once.

    Pills are the innermost elements of containers whose class speaks of pills, also inside a header that is dropped;
    badges are short leaves anywhere else but in dropped furniture. Texts cut short come out in full.
    """
    root = _tree(html)
    keep = kept_wrappers(root)
    out: dict[str, tuple[str, str]] = {}
    todo = [(root, False, False)]
    while todo:
        element, pills, dropped = todo.pop()
        pills = pills or "pill" in element[1].get("class", "")
        dropped = dropped or (element[0] in DROPPED and element[2] not in keep)
        inner = [c for c in element[3] if not isinstance(c, str) and "tooltip" not in c[1].get("class", "")]
        if not inner and element[0] and (pills or not dropped):
            text = full_value(element)
            if text and len(text) <= (PILL_CHARS if pills else LEAF_CHARS) and BADGE.search(text):
                out.setdefault(text.lower(), (text, "pill" if pills else "badge"))
        todo.extend((c, pills, dropped) for c in reversed(inner))
    return list(out.values())


def badges_of_html(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, text, origin): the badges of every page; null and empty pages have none."""
    ship_package(pages.sparkSession)
    kind = pages.schema[ident].dataType

    def run(batches):
        from tarn.operators.nodes import page_badges

        for batch in batches:
            found = [(i, *b) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for b in page_badges(h)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], batch.schema.field(0).type), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], ["id", "text", "origin"])

    out = pages.select(F.col(ident).alias("id"), F.col(html).alias("html")).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType()), T.StructField("origin", T.StringType())]))
    return out.withColumnRenamed("id", ident)


def faq_entries(document: str) -> list[tuple[str, str]]:
    """Questions and answers of a JSON-LD FAQPage; anything else gives none."""
    try:
        data = json.loads(document)
    except ValueError:
        return []
    out = []
    for page in data if isinstance(data, list) else [data]:
        if not isinstance(page, dict) or page.get("@type") != "FAQPage":
            continue
        entries = page.get("mainEntity") or []
        for e in entries if isinstance(entries, list) else [entries]:
            answer = e.get("acceptedAnswer") if isinstance(e, dict) else None
            if isinstance(answer, dict) and e.get("name") and answer.get("text"):
                out.append((e["name"], re.sub(r"<[^>]+>", " ", answer["text"])))
    return out


def html_nodes(html: str) -> list[dict]:
    """Nodes of a page in order: headings, paragraphs, list entries, quotes, table rows, and FAQ entries of JSON-LD last.

    What lies in menus, footers, forms, scripts and the like is dropped. Of equal nodes the first stays.
    """
    parser = _Nodes(kept_wrappers(_tree(html)) if any(html and html.count(label) for label in GRID_LABELS) else frozenset())
    parser.feed(html or "")
    parser.close()
    nodes = parser.nodes
    for document in parser.ld:
        for q, a in faq_entries(document):
            a = " ".join(a.split())
            nodes.append({"node_type": "accordion", "text": f"{q} {a}", "node_level": None, "label": q, "value": a, "origin": "jsonld"})
    seen, out = set(), []
    for n in nodes:
        key = (n["node_type"], n["text"][:160])
        if key not in seen:
            seen.add(key)
            out.append(n | {"node_order": len(out)})
    return out


def nodes_of_html(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, nodes) of every page; null or empty pages have an empty list. Whole pages are read."""
    ship_package(pages.sparkSession)
    kind = pages.schema[ident].dataType
    fields = pa.list_(pa.struct([("node_type", pa.string()), ("text", pa.string()), ("node_level", pa.int32()), ("label", pa.string()), ("value", pa.string()), ("node_order", pa.int32()), ("origin", pa.string())]))

    def run(batches, fields=fields):
        from tarn.operators.nodes import html_nodes

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_nodes(h) for h in batch.column(1).to_pylist()], fields)], ["id", "nodes"])

    out = pages.select(F.col(ident).alias("id"), F.col(html).alias("html")).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("nodes", T.ArrayType(NODE))]))
    return out.withColumnRenamed("id", ident)


def as_html(nodes: Column) -> Column:
    """A plain HTML page out of an array of (node_type, text, node_level) nodes, with a menu and a footer around it."""
    esc = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    level = lambda n: F.coalesce(n["node_level"], F.lit(2)).cast("string")
    one = lambda n: F.when(n["node_type"] == "heading", F.concat(F.lit("<h"), level(n), F.lit(">"), esc(n["text"]), F.lit("</h"), level(n), F.lit(">"))).when(n["node_type"] == "list_item", F.concat(F.lit("<ul><li>"), esc(n["text"]), F.lit("</ul>"))).otherwise(F.concat(F.lit("<p>"), esc(n["text"])))
    return F.concat(F.lit("<html><body><nav><ul><li>Menu</ul></nav><article>"), F.array_join(F.transform(nodes, one), "\n"), F.lit("</article><footer><p>Imprint</p></footer></body></html>"))
