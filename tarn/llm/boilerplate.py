"""Menus, notices, teasers and footers among the nodes of web pages, by suffix arrays per site.

The token streams of a site's pages are put end to end, with a mark between nodes and at separators. A suffix array
over them (prefix doubling) gives every substring of LONG tokens, and every whole entry between two marks, with the
number of distinct pages it stands on; substrings may cross nodes. What stands on a large share of a site's pages is
the site's template. The template shows where a page's frame lies and which headings open a side block. Unique runs
are kept, but for what the template encloses: entries of a confirmed frame and of side blocks. A check follows for
texts that the array leaves open: prose goes if enough of its word triples are known from the template's texts and
rare in unique prose, short entries go if most of their occurrences on all pages lie in template runs. No wording is
given beforehand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import kept, ship_package

#: Tokens of a substring. Shorter entries count where they stand alone between two marks.
LONG = 6
#: A substring is repeated if it stands on so many distinct pages of its site and on this share of them.
PAGES, REPEATED = 3, 0.01
#: Repeated text is the site's template if it stands on this share of its pages: for entries, and for sentences.
TEMPLATE, TEMPLATE_PROSE = 0.06, 0.10
#: The share of a node's tokens that must be repeated so often is one less this quantile.
QUANTILE = 0.2
#: Characters of a site that share one suffix array; larger sites are spread over shards whose counts are added up.
SHARD_CHARS = 8_000_000
#: An entry is judged by its occurrences on all pages if there are so many; and the share of them that decides.
SEEN, SHARE = 3, 0.5
#: A word triple is the template's if it stands in this share of its distinct texts and is rarer in unique prose;
#: prose goes if this share of its triples are the template's.
BANK, COVERED = 0.0005, 0.2
#: Texts whose tokens a worker remembers.
REMEMBERED = 100_000

_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\d+")
_PIECE = regex.compile(r"[\p{L}\p{M}]+|\d+|[|·•»›>→/\\]|::")
_SENTENCE_END = regex.compile(r"[.!?।॥]['\"”’)\]]*$")
# How a text ends that is cut short or points to the rest.
_CUT_SHORT = regex.compile(r"(…|\.\.\.|(read|see|learn|know) more|continue reading|view all)\s*[»›>→]?$", regex.I)

MAIN, SURE, OPEN, PROSE = 0, 1, 2, 3


def _tokens(text: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in _TOKEN.findall(text.lower())]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Stream:
    """The token streams of some pages of one site; symbol 0 is the mark between nodes, entries and pages."""

    def __init__(self, texts: list, page: np.ndarray):
        self.numbers: dict[str, int] = {}
        symbol: list[int] = []
        node: list[int] = []
        known: dict[str, list[int]] = {}
        for at, text in enumerate(texts):
            symbol.append(0)
            node.append(-1)
            if not text:
                continue
            found = known.get(text)
            if found is None:
                found = [self.numbers.setdefault("0" if t.isdigit() else t, len(self.numbers) + 1) if t[0].isalnum() or _TOKEN.match(t) else 0 for t in _PIECE.findall(text.lower())]
                if len(known) < REMEMBERED:
                    known[text] = found
            symbol += found
            node += [at] * len(found)
        symbol.append(0)
        node.append(-1)
        self.symbol = np.array(symbol, np.int64)
        self.node = np.array(node, np.int64)
        # the mark before a node belongs to the node's page
        owner = np.zeros(len(symbol), np.int64)
        marks = np.flatnonzero(self.node < 0)
        owner[marks[:-1]] = np.arange(len(texts)) if len(texts) else 0
        inside = self.node >= 0
        owner[inside] = self.node[inside]
        self.page = page[owner] if len(texts) else np.empty(0, np.int64)
        if len(texts):
            self.page[-1] = page[-1]
        self.node[self.symbol == 0] = -1

    def names(self) -> np.ndarray:
        """A 64-bit name of every symbol, the same in every shard."""
        out = np.empty(len(self.numbers) + 1, np.uint64)
        out[0] = 1
        for token, k in self.numbers.items():
            out[k] = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return out


def substrings(symbol: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, pages) of every substring of LONG symbols and of every shorter whole entry with its two marks.

    The suffixes are ranked by 1, 2, 4 symbols by doubling; two overlapping ranks name a substring of any length up to
    8. Suffixes of equal name lie together in the array; `pages` counts the distinct pages among them.
    """
    n = len(symbol)
    empty = np.empty(0, np.int64)
    if not n:
        return empty, empty, empty
    rank = {1: np.unique(symbol, return_inverse=True)[1].astype(np.int64)}
    for size in (1, 2):
        tail = np.zeros(n, np.int64)
        tail[: n - size] = rank[size][size:] + 1
        rank[2 * size] = np.unique(rank[size] * (n + 2) + tail, return_inverse=True)[1].astype(np.int64)
    marks = np.flatnonzero(symbol == 0)
    gap = np.diff(marks)
    found = []
    for length in range(3, LONG + 2):
        start = marks[:-1][gap == length - 1]
        if length == LONG:
            every = np.arange(max(0, n - length + 1))
            start = every[page[every] == page[every + length - 1]]
        half = 2 if length < 4 else 4
        start = start[page[start] == page[start + length - 1]] if len(start) else start
        if not len(start):
            continue
        name = np.unique(rank[half][start] * (n + 2) + rank[half][start + length - half], return_inverse=True)[1].astype(np.int64)
        order = np.lexsort((page[start], name))
        first = np.r_[True, name[order][1:] != name[order][:-1]]
        other = first | np.r_[True, page[start][order][1:] != page[start][order][:-1]]
        many = np.add.reduceat(other.astype(np.int64), np.flatnonzero(first))
        found.append((start, np.full(len(start), length), many[name]))
    if not found:
        return empty, empty, empty
    return tuple(np.concatenate(c) for c in zip(*found))


def named(symbol: np.ndarray, names: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The 64-bit name of each substring, the same in every shard."""
    word = names[symbol]
    out = np.zeros(len(start), np.uint64)
    for k in range(int(length.max()) if len(length) else 0):
        live = length > k
        x = (out[live] ^ word[start[live] + k]) * np.uint64(0x9E3779B97F4A7C15)
        out[live] = x ^ (x >> np.uint64(29))
    return out


def strength(stream: Stream, nodes: int, start: np.ndarray, length: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """The number of pages on which almost all of each node's tokens are repeated."""
    best = np.zeros(len(stream.symbol), np.int64)
    for size in np.unique(length):  # substrings of one length have different starts
        at, many = start[length == size], pages[length == size]
        for k in range(size):
            best[at + k] = np.maximum(best[at + k], many)
    inside = stream.node >= 0
    node, value = stream.node[inside], best[inside]
    order = np.lexsort((value, node))
    node, value = node[order], value[order]
    first = np.searchsorted(node, np.arange(nodes))
    size = np.searchsorted(node, np.arange(nodes), "right") - first
    out = np.zeros(nodes, np.int64)
    some = size > 0
    out[some] = value[first[some] + (size[some] * QUANTILE).astype(np.int64)]
    return out


def prose(text: str) -> bool:
    """A sentence or more of running text."""
    return len(text.split()) >= 4 and bool(_SENTENCE_END.search(text[-60:])) and not _CUT_SHORT.search(text[-60:])


def phrase(text: str) -> bool:
    """A list entry that goes on from a sentence: it begins in lower case."""
    return len(text.split()) >= 3 and text[0].islower() and text[0].isascii()


def page_verdicts(kind: list, level: list, label: list, texts: list, pages: list, of: int) -> tuple[list, list, list]:
    """(verdict, evidence, trains) of each node of a page in order.

    pages: on how many of the site's `of` pages the node's text is repeated. Verdicts are MAIN, SURE (boilerplate),
    OPEN (an entry to be judged by all its occurrences) and PROSE (to be judged by its word triples); evidence says
    that an entry stands like boilerplate; trains is 1 for texts of the template, 0 for unique prose, else None.
    """
    n = len(texts)
    clean = [" ".join((t or "").split()) for t in texts]
    least = max(PAGES, REPEATED * of)
    # what a node is by itself: A own content, F labelled fact, H side heading of the template, h other low heading,
    # T template, P sentences that are repeated, t anything else
    form = []
    for i in range(n):
        k, t, q = kind[i], clean[i], pages[i]
        if k == "heading":
            form.append("A" if (level[i] or 1) <= 2 else "H" if q >= least else "h")
        elif k in ("accordion", "quote"):
            form.append("A")
        elif label[i]:
            form.append("F")
        elif not t:
            form.append("t")
        elif prose(t):
            form.append("A" if q < least else "T" if q >= max(PAGES, TEMPLATE_PROSE * of) else "P")
        elif k == "list_item" and phrase(t):
            form.append("A")
        else:
            form.append("T" if q >= max(PAGES, TEMPLATE * of) else "t")
    # a side block: entries under a heading of the template until own content begins
    # (under a low heading that is not the template's, what stands there is only open to doubt)
    side, doubt = [False] * n, [False] * n
    under, entry = None, None
    for i in range(n):
        if form[i] in "Hh":
            under, entry = side if form[i] == "H" else doubt, None
            under[i] = True
            continue
        if under is None:
            continue
        k = "table_row" if label[i] else kind[i]
        if form[i] == "A" or (form[i] == "F" and entry is None and k != "table_row"):
            under = None
        else:
            entry, under[i] = k, True
    anchors = [i for i in range(n) if form[i] == "A" or (form[i] == "F" and not side[i])]
    heads = [i for i in anchors if kind[i] == "heading"]
    first = heads[0] if heads else anchors[0] if anchors else n
    last = anchors[-1] if anchors else -1
    # the frame before the first own heading and after the last own content, where the template confirms it
    framed = [not anchors or any(f in "TH" for f in form[:first]), not anchors or any(f in "TH" for f in form[last + 1 :])]
    before = [i < first and framed[0] for i in range(n)]
    after = [i > last and framed[1] for i in range(n)]
    # entries in one run share the run's evidence
    run = [0.0] * n
    i = 0
    while i < n:
        j = i
        while j < n and kind[j] == "list_item" and form[j] in "Tt":
            j += 1
        for m in range(i, j):
            run[m] = sum(f == "T" for f in form[i:j]) / (j - i)
        i = max(j, i + 1)
    verdict, evidence, trains = [OPEN] * n, [False] * n, [None] * n
    for i in range(n):
        f = form[i]
        inner = first <= i <= last and not side[i]
        sentences = kind[i] != "heading" and bool(clean[i]) and prose(clean[i])
        if f == "A":
            verdict[i] = SURE if before[i] and kind[i] in ("paragraph", "list_item") else PROSE if sentences and kind[i] == "paragraph" else MAIN
        elif f == "F":
            verdict[i] = OPEN if side[i] or doubt[i] else SURE if before[i] else MAIN
            evidence[i] = side[i]
        elif f == "H":
            ahead = next((j for j in range(i + 1, n) if clean[j]), None)
            verdict[i] = OPEN if inner and ahead is not None and form[ahead] == "A" and kind[ahead] == "paragraph" else SURE
            evidence[i] = before[i] or after[i]
        elif f == "h":
            ahead = next((j for j in range(i + 1, n) if clean[j]), None)
            evidence[i] = before[i] or after[i] or not (ahead is not None and form[ahead] in "AF")
        elif f == "T":
            verdict[i] = PROSE if sentences and inner else SURE
        elif f == "P":
            verdict[i] = SURE if before[i] else PROSE
        else:
            verdict[i] = OPEN if not clean[i] else SURE if before[i] or (kind[i] == "paragraph" and (after[i] or side[i])) else PROSE if kind[i] == "paragraph" else OPEN
            evidence[i] = before[i] or (after[i] and not clean[i]) or side[i] or run[i] >= SHARE or not anchors
        if not label[i] and clean[i]:
            if verdict[i] == SURE or f == "T" or (side[i] and f in "tP"):
                trains[i] = 1
            elif f == "A" and verdict[i] in (MAIN, PROSE) and kind[i] != "heading":
                trains[i] = 0
    for i in range(n):  # what is sure here is evidence for the same text elsewhere
        evidence[i] = evidence[i] or verdict[i] == SURE
    return verdict, evidence, trains


_OUT = "node_id bigint, page_id bigint, kind string, key binary, verdict int, evidence boolean, trains int, words string"
_IN = ("node_id", "page_id", "node_order", "node_type", "node_level", "label", "text", "of")


def _ordered(table: pa.Table) -> tuple[dict, np.ndarray]:
    """The columns of a shard in page order, repeated rows once, and the number of each node's page."""
    rows = table.to_pydict()
    first = dict(zip(reversed(rows["node_id"]), range(table.num_rows - 1, -1, -1)))
    order = sorted(first.values(), key=lambda i: (rows["page_id"][i], rows["node_order"][i] if rows["node_order"][i] is not None else -1, rows["node_id"][i]))
    rows = {k: [v[i] for i in order] for k, v in rows.items()}
    return rows, np.unique(np.array(rows["page_id"], np.int64), return_inverse=True)[1].astype(np.int64)


def _frequent(table: pa.Table) -> pa.Table:
    """(name) of the substrings that are repeated within one shard of a site; what is repeated on the site is so in a shard."""
    rows, page = _ordered(table)
    stream = Stream(rows["text"], page)
    start, length, pages = substrings(stream.symbol, stream.page)
    many = pages >= REPEATED * (page[-1] + 1)
    found = np.unique(named(stream.symbol, stream.names(), start[many], length[many]))
    return pa.table([pa.array(found.view(np.int64))], ["name"])


def _counted(table: pa.Table, names: pa.Table) -> pa.Table:
    """(name, pages) of the given substrings in one shard of a site."""
    if not table.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["name", "pages"])
    rows, page = _ordered(table)
    stream = Stream(rows["text"], page)
    start, length, pages = substrings(stream.symbol, stream.page)
    name, first = np.unique(named(stream.symbol, stream.names(), start, length).view(np.int64), return_index=True)
    asked = np.isin(name, names.column("name").to_numpy())
    return pa.table([pa.array(name[asked]), pa.array(pages[first[asked]])], ["name", "pages"])


def _judged(table: pa.Table, totals: pa.Table | None) -> pa.Table:
    """The nodes of one shard with their verdicts; totals are the page counts over all shards of the site, if there are several."""
    types = pa.schema([("node_id", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("key", pa.binary()), ("verdict", pa.int32()), ("evidence", pa.bool_()), ("trains", pa.int32()), ("words", pa.string())])
    if not table.num_rows:
        return types.empty_table()
    rows, page = _ordered(table)
    n = len(page)
    stream = Stream(rows["text"], page)
    start, length, pages = substrings(stream.symbol, stream.page)
    if totals is not None:
        name = named(stream.symbol, stream.names(), start, length).view(np.int64)
        frequent = totals.column("name").to_numpy()
        order = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent, name, sorter=order), max(len(frequent) - 1, 0))
        pages = np.where(frequent[order[at]] == name, totals.column("pages").to_numpy()[order[at]], 0) if len(frequent) else np.zeros_like(pages)
    many = strength(stream, n, start, length, pages).tolist()
    out: dict[str, list] = {k: [] for k in types.names}
    known: dict[str, tuple] = {}
    cuts = np.flatnonzero(np.r_[True, page[1:] != page[:-1], True]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        kinds, labels = rows["node_type"][a:b], [(x or "").strip() for x in rows["label"][a:b]]
        texts = rows["text"][a:b]
        verdict, evidence, trains = page_verdicts(kinds, rows["node_level"][a:b], labels, texts, many[a:b], rows["of"][a])
        for j in range(b - a):
            text = labels[j] or texts[j] or ""
            found = known.get(text)
            if found is None:
                words = " ".join(_tokens(text))
                found = words, _digest(words) if words else None
                if len(known) < REMEMBERED:
                    known[text] = found
            words = found[0]
            out["kind"].append("row" if labels[j] else kinds[j])
            out["key"].append(found[1])
            out["words"].append(words if trains[j] is not None or verdict[j] == PROSE else None)
        out["node_id"] += rows["node_id"][a:b]
        out["page_id"] += rows["page_id"][a:b]
        out["verdict"] += verdict
        out["evidence"] += evidence
        out["trains"] += trains
    return pa.table(out, schema=types)


def verdicts(page_nodes: DataFrame, fetch_log: DataFrame, *, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(node_id, page_id, kind, key, verdict, evidence, trains, words) of every node, site by site.

    A site is the publisher of a page's fetches, or the host of its url; pages without a fetch form a site of their
    own. A site of more than shard_chars characters is spread over shards by the hash of its pages. Substrings that
    are repeated in some shard are then counted in all of them, so page counts do not depend on the shards.
    """
    ship_package(page_nodes.sparkSession)
    site = F.coalesce(F.col("publisher"), F.regexp_extract("url", r"https?://([^/]+)", 1))
    sites = fetch_log.where("page_id is not null").groupBy("page_id").agg(F.min(site).alias("site"))
    nodes = page_nodes.where("node_id is not null and page_id is not null").select("node_id", "page_id", "node_order", "node_type", "node_level", "label", "text")
    pages = nodes.groupBy("page_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars")).join(sites, "page_id", "left").withColumn("site", F.coalesce("site", F.lit("")))
    sizes = pages.groupBy("site").agg(F.count("*").alias("of"), F.ceil(F.sum("chars") / shard_chars).cast("int").alias("shards"))
    placed = pages.join(sizes, "site").select("page_id", "site", "of", "shards", F.pmod(F.xxhash64("page_id"), F.col("shards")).cast("int").alias("shard"))
    placed = kept(placed)
    all_rows = nodes.join(placed, "page_id").select("site", "shard", "shards", *_IN)

    def run(table):
        from tarn.llm.boilerplate import _judged

        return _judged(table, None)

    whole = all_rows.where("shards = 1").groupBy("site", "shard").applyInArrow(run, _OUT)
    split = placed.where("shards > 1").select("site", "shard").distinct()
    if not split.limit(1).count():
        return whole
    rows = all_rows.where("shards > 1")

    def candidates(key, table):
        from tarn.llm.boilerplate import _frequent

        found = _frequent(table)
        return found.add_column(0, "site", pa.array([key[0].as_py()] * found.num_rows, pa.string()))

    def counts(key, table, names):
        from tarn.llm.boilerplate import _counted

        found = _counted(table, names)
        return found.add_column(0, "site", pa.array([key[0].as_py()] * found.num_rows, pa.string()))

    def judge(key, table, totals):
        from tarn.llm.boilerplate import _judged

        return _judged(table, totals)

    names = rows.groupBy("site", "shard").applyInArrow(candidates, "site string, name bigint").distinct()
    asked = names.join(split, "site").groupBy("site", "shard")
    counted = rows.groupBy("site", "shard").cogroup(asked).applyInArrow(counts, "site string, name bigint, pages bigint")
    totals = counted.groupBy("site", "name").agg(F.sum("pages").alias("pages"))
    return whole.unionByName(rows.groupBy("site", "shard").cogroup(totals.join(split, "site").groupBy("site", "shard")).applyInArrow(judge, _OUT))


def _triples(df: DataFrame, *columns: str) -> DataFrame:
    """df's columns and `g`, the distinct triples of its `words` as numbers; words and triples are hashed once each.

    Take the triples out with explode_outer: for explode the planner puts a filter on the array below these steps,
    and there it would hash all words anew for every triple.
    """
    hashed = df.select(*columns, F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("_h"))
    triple = lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))
    return hashed.select(*columns, F.array_distinct(F.when(F.size("_h") > 2, F.transform(F.sequence(F.lit(0), F.size("_h") - 3), triple)).otherwise(F.array().cast("array<bigint>"))).alias("g"))


def boilerplate_nodes(page_nodes: DataFrame, fetch_log: DataFrame, *, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(node_id) of the nodes that are not main body.

    A label and value under a side heading is boilerplate only if its label stands there on most pages (SEEN at least).
    Repeated rows count once; rows without node_id or page_id are left out; null texts, labels and levels are read as
    empty; extra columns are not read; an empty input gives an empty result.
    """
    seen = kept(verdicts(page_nodes, fetch_log, shard_chars=shard_chars))
    # prose by its word triples; the triples kept number at most the mean of a text over BANK
    tasks = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = seen.where("trains is not null and words is not null").repartition(tasks, "key").groupBy("key").agg(F.max("trains").alias("trains"), F.min("words").alias("words"))
    texts = kept(texts.select("trains", "words"))
    triples = lambda kind: _triples(texts.where(F.col("trains") == kind), "trains").select(F.explode_outer("g").alias("g"))
    total = {r.trains: r.n for r in texts.groupBy("trains").agg(F.count("*").alias("n")).collect()}
    least = max(2, BANK * total.get(1, 0))
    template = triples(1).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = triples(0).join(F.broadcast(template.select("g")), "g").groupBy("g").agg(F.count("*").alias("m"))
    bank = template.join(own, "g", "left").where(F.col("n") * (total.get(0, 0) + 1) > F.coalesce("m", F.lit(0)) * (total.get(1, 0) + 1)).select("g")
    open_prose = seen.where(F.col("verdict") == PROSE).select("key", "words").repartition(tasks, "key").groupBy("key").agg(F.min("words").alias("words"))
    known = _triples(open_prose, "key").select("key", F.size("g").alias("size"), F.explode_outer("g").alias("g")).join(F.broadcast(bank), "g").groupBy("key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    like_template = known.where(F.col("n") >= COVERED * F.col("size")).select("key")
    by_words = seen.where(F.col("verdict") == PROSE).join(like_template, "key").select("node_id")
    # entries, and prose that the words do not tell, by all their occurrences
    stats = seen.where("key is not null").groupBy("kind", "key").agg(F.count("*").alias("n"), F.avg(F.col("evidence").cast("double")).alias("share")).where(F.col("n") >= SEEN)
    entries = seen.where(F.col("verdict").isin(OPEN, PROSE)).join(stats, ["kind", "key"], "left")
    settled = entries.where(F.coalesce(F.col("share") >= SHARE, F.col("evidence") & (F.col("kind") != "row") & (F.col("verdict") == OPEN))).select("node_id")
    return seen.where(F.col("verdict") == SURE).select("node_id").unionByName(by_words).unionByName(settled).distinct()


def main_body(page_nodes: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """(page_id, n_nodes, body): the main body of every page that has one, its nodes in order, one per line."""
    ids = boilerplate_nodes(page_nodes, fetch_log)
    nodes = page_nodes.where("node_id is not null and page_id is not null").dropDuplicates(["node_id"]).join(ids, "node_id", "left_anti")
    texts = nodes.where("trim(text) <> ''").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_order", "node_id", "text"))).alias("x"))
    return texts.select("page_id", F.size("x").alias("n_nodes"), F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("body"))
