import numpy as np
import pyarrow as pa

from tarn.llm import boilerplate as B

SCHEMA = "node_id long, page_id long, node_order int, node_type string, node_level int, label string, value string, text string, kind string"
LOG = "page_id long, publisher string, url string"


def naive(symbol, page):
    """(start, length) to the number of pages of each substring, by counting."""
    spans = [(i, B.LONG) for i in range(len(symbol) - B.LONG + 1)]
    marks = [i for i, x in enumerate(symbol) if x == 0]
    spans += [(a, b - a + 1) for a, b in zip(marks, marks[1:]) if 3 <= b - a + 1 <= B.LONG + 1 and b - a + 1 != B.LONG]
    spans = [(i, n) for i, n in spans if page[i] == page[i + n - 1]]
    where = {}
    for i, n in spans:
        where.setdefault(tuple(symbol[i : i + n]), set()).add(page[i])
    return {(i, n): len(where[tuple(symbol[i : i + n])]) for i, n in spans}


def test_suffix_array_equals_counting():
    r = np.random.default_rng(0)
    symbol, page = [], []
    shared = r.integers(0, 9, 40).tolist()
    for p in range(12):
        own = r.integers(0, 30, 30).tolist()
        a = int(r.integers(0, 20))
        tokens = [0, *own[:15], *shared[a : a + int(r.integers(5, 20))], 0, 3, 0, 7, 8, 0, *own[15:]]
        symbol += tokens
        page += [p] * len(tokens)
    symbol, page = np.array(symbol), np.array(page)
    start, length, pages = B.substrings(symbol, page)
    assert {(i, n): m for i, n, m in zip(start.tolist(), length.tolist(), pages.tolist())} == naive(symbol.tolist(), page.tolist())
    names = r.integers(1, 1 << 60, 40).astype(np.uint64)
    name = B.named(symbol, names, start, length)
    texts = {}
    for i, n, x in zip(start.tolist(), length.tolist(), name.tolist()):
        assert texts.setdefault(x, tuple(symbol[i : i + n])) == tuple(symbol[i : i + n])
    assert not len(B.substrings(np.empty(0, np.int64), np.empty(0, np.int64))[0])


def test_stream_marks_nodes_and_separators():
    stream = B.Stream(["Home > Funds", None, "मेनू 12", ""], np.array([0, 0, 1, 1]))
    assert (stream.symbol == 0).tolist() == [True, False, True, False, True, True, False, False, True, True]
    assert stream.page.tolist() == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1] and stream.node.tolist() == [-1, 0, -1, 0, -1, -1, 2, 2, -1, -1]


def site(pages=12):
    """Pages of one site: menu, title, facts, text, teasers, footer. Returns rows and the boilerplate's ids."""
    rows, bad = [], set()

    def add(page, kind, text, boilerplate, level=None, label=None, value=None):
        rows.append((len(rows), page, sum(r[1] == page for r in rows), kind, level, label, value, text, "x"))
        if boilerplate:
            bad.add(len(rows) - 1)

    for p in range(pages):
        add(p, "paragraph", "We use cookies to measure how pages are used.", True)
        for m in ("Home page", "Our funds", "Learn more", "Contact desk", "Log in now"):
            add(p, "list_item", m, True)
        add(p, "heading", f"Fund number {p} of the house", False, 1)
        add(p, "table_row", f"NAV: {p}.5", False, None, "NAV", f"{p}.5")
        add(p, "list_item", "Share", True)
        add(p, "paragraph", "This paragraph stands on every page and is still content of the page.", False)
        add(p, "paragraph", f"Only page {p} tells you that the clerk number {p * 7} waits at the desk.", False)
        add(p, "list_item", "rounds the balance to 3 decimals", False)
        add(p, "accordion", "Who can add a nominee? The holder can.", False, None, "Who can add a nominee?", "The holder can.")
        add(p, "heading", "Also of interest", True, 3)
        add(p, "list_item", f"Three mistakes to avoid in {2000 + p}", True)
        add(p, "paragraph", f"A guide for number {p}. The desk tells you how the… Read more", True)
        for m in ("Privacy policy", "Terms of use", "Site map", "Voting record", "Back to top"):
            add(p, "list_item", m, True)
        add(p, "paragraph", "© 2024 House. All rights reserved.", True)
    return rows, bad


def test_site(spark):
    rows, bad = site()
    rows = rows + rows[:30] + [(None, 1, 1, "paragraph", None, None, None, "x", "x"), (9001, None, 1, None, None, None, None, None, None)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    log = spark.createDataFrame([(p, "House" if p % 2 else None, "https://www.house.example/x") for p in range(11)], LOG)
    got = {r.node_id for r in B.boilerplate_nodes(nodes, log).collect()}
    assert got == bad
    body = {r.page_id: r for r in B.main_body(nodes, log).collect()}
    assert len(body) == 12 and body[3].n_nodes == 6 and body[3].body.startswith("Fund number 3")


def test_shards_change_nothing(spark):
    rows, bad = site(40)
    nodes, log = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(p, "House", "x") for p in range(40)], LOG)
    assert {r.node_id for r in B.boilerplate_nodes(nodes, log, shard_chars=6_000).collect()} == bad
    columns = ("node_id", "verdict", "evidence", "trains")
    want = sorted(tuple(r) for r in B.verdicts(nodes, log).select(*columns).collect())
    assert sorted(tuple(r) for r in B.verdicts(nodes, log, shard_chars=6_000).select(*columns).collect()) == want


def test_the_array_decides(spark, monkeypatch):
    rows, bad = site()
    table = pa.table({k: [r[i] for r in rows] for i, k in ((0, "node_id"), (1, "page_id"), (2, "node_order"), (3, "node_type"), (4, "node_level"), (5, "label"), (7, "text"))} | {"of": [12] * len(rows)})
    sure = lambda: {r["node_id"] for r in B._judged(table, None).to_pylist() if r["verdict"] == B.SURE or (r["evidence"] and r["verdict"] == B.OPEN)}
    assert sure() == bad
    monkeypatch.setattr(B, "substrings", lambda symbol, page: (np.empty(0, np.int64),) * 3)
    assert len(sure()) < len(bad) / 10


def test_notices_in_any_words_and_prompts_among_the_text(spark):
    """Prose of the template is known by its word triples where its own wording is rare; own prose on many pages stays."""
    parts = [("A short zib helps the blue wex to load", "faster on every visit.", "when you come back here."), ("The qum of this plox keeps a small nim", "on your machine for now.", "until the day is over.")]
    rows, bad = [], set()
    r = np.random.default_rng(4)
    own = lambda: " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(12)) + "."
    for p in range(60):
        add = lambda kind, text, boil, level=None: (rows.append((len(rows), p, len(rows), kind, level, None, None, text, "x")), boil and bad.add(len(rows) - 1))
        for m in ("Home page", "Our funds", "Contact desk"):
            add("list_item", m, True)
        head = parts[p % 2]
        if p % 3:
            add("paragraph", f"{head[0]} {head[1 + p % 4 // 2]}", True)
        add("heading", f"Fund {'abcdefghij'[p % 10]}{'klmnop'[p // 10]}", False, 1)
        add("paragraph", own(), False)
        if p % 12 == 0:
            add("paragraph", f"{head[0]} {head[2]}", True)
        if p % 5 == 0:
            add("paragraph", "The registrar keeps the paper for eight years and then burns it.", False)
        add("paragraph", own(), False)
        for m in ("Privacy policy", "Terms of use", "Site map"):
            add("list_item", m, True)
    nodes, log = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(p, "House", "x") for p in range(60)], LOG)
    assert {r.node_id for r in B.boilerplate_nodes(nodes, log).collect()} == bad


def test_odd_tables(spark):
    log = spark.createDataFrame([], LOG)
    assert B.boilerplate_nodes(spark.createDataFrame([], SCHEMA), log).count() == 0
    rows = [(1, 1, None, None, None, None, None, None, None), (2, 1, 0, "paragraph", None, None, None, "", None), (3, 1, 0, "paragraph", None, None, None, "A sentence of text that goes on. " * 3_000, None), (4, 2, 0, "list_item", None, None, None, "Menu", None)]
    got = {r.node_id for r in B.boilerplate_nodes(spark.createDataFrame(rows, SCHEMA), log).collect()}
    assert 3 not in got and 4 in got
