from tarn.operators import answers as A
from tarn.operators import chunking as C
from tarn.operators import nodes as N

PAGE = """<html><head><script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"name": "Who?", "acceptedAnswer": {"text": "<b>We</b> do."}}]}</script>
<script>var x = "<p>no</p>"</script></head><body><nav><ul><li>Menu</ul></nav><h1>Fund &amp; Co</h1><p>First<br>line<p>Second<ul><li>One<li>Two <b>bold</b></ul>
<table><tr><td>NAV<td>10.5<tr><th>AUM<th>5 cr<th>more</table><blockquote>Said.</blockquote><p>Second</p><footer><p>Imprint</p></footer></body></html>"""


def test_nodes_of_a_page():
    got = [(n["node_type"], n["text"], n["label"], n["value"]) for n in N.html_nodes(PAGE)]
    assert got == [
        ("heading", "Fund & Co", None, None), ("paragraph", "First line", None, None), ("paragraph", "Second", None, None), ("list_item", "One", None, None), ("list_item", "Two bold", None, None),
        ("table_row", "NAV: 10.5", "NAV", "10.5"), ("table_row", "AUM: 5 cr | more", "AUM", "5 cr | more"), ("quote", "Said.", None, None), ("accordion", "Who? We do.", "Who?", "We do."),
    ]
    assert [n["node_order"] for n in N.html_nodes(PAGE)] == list(range(9))


HEADER = """<header><div class="abc_pills_container"><a href="#"><span>ELSS - 3Y Lock-in</span></a><a><span>Blue chip</span></a></div><p>Log in</p></header>"""


def test_badges_of_a_page():
    page = HEADER + """<div><span>Exit Load nil</span><div class="v">Benchmark: Merid 100 (Total Ret...<div class="big-tooltip"><span>Benchmark: Merid 100 (Total Return)</span></div></div>
    <span title="Minimum amount is 500 rupees">Minimum amount…</span><span title="other">NAV cut…</span><p>NAV</p><span>exit load NIL</span></div><footer><span>NAV of old</span></footer>"""
    assert N.page_badges(page) == [
        ("ELSS - 3Y Lock-in", "pill"), ("Exit Load nil", "badge"), ("Benchmark: Merid 100 (Total Return)", "badge"), ("Minimum amount is 500 rupees", "badge"), ("NAV cut…", "badge"), ("NAV", "badge"),
    ]
    assert N.page_badges("") == [] and N.page_badges(None) == [] and N.page_badges("<p>" + "NAV " * 50) == []


def test_memory_reaches_over_the_parts_of_a_long_conversation(spark):
    import random

    r = random.Random(1)
    turns = [(c, i, f"e{i}" if r.random() < 0.15 else None, "x") for c in ("long", None, "short") for i in range(900 if c == "long" else 40)]
    r.shuffle(turns)
    df = spark.createDataFrame(turns, "c string, turn int, entity string, _n string")
    got = {(x.c, x.turn): x.context for x in A.remembered(df.drop("_n"), "c", ["turn"], "entity", reach=10).collect()}
    entity = {(c, i): e for c, i, e, _ in turns}
    want = {(c, i): e or next((entity[c, j] for j in range(i - 1, max(-1, i - 11), -1) if entity[c, j]), None) for (c, i), e in entity.items()}
    assert got == want


def test_a_wrapper_with_a_grid_of_facts_is_kept():
    grid = "<table><tr><td>TER<td>1%</tr><tr><td>Exit Load<td>nil</tr><tr><td>AUM<td>5 cr</tr></table>"
    texts = lambda html: [n["text"] for n in N.html_nodes(html)]
    assert texts(f"<aside>{grid}<p>Inside</p></aside><p>After</p>") == ["TER: 1%", "Exit Load: nil", "AUM: 5 cr", "Inside", "After"]
    assert texts("<aside><table><tr><td>TER<td>1%</tr></table><p>Inside</p></aside><p>After</p>") == ["After"]


def test_merge_of_small_neighbours_of_one_subject(spark):
    rows = spark.createDataFrame([(1, 0, "exit load of the plan"), (1, 1, "the exit load is nil"), (1, 2, "bank branch opens at noon"), (1, 3, None), (2, 0, "nav " * 60), (2, 1, "nav")], "p int, o int, t string")
    got = sorted((r.p, r.first_order, r.pieces) for r in C.merged_if_alike(rows, "p", "o", "t").collect())
    assert got == [(1, 0, 2), (1, 2, 1), (2, 0, 1), (2, 1, 1)]
    many = spark.createDataFrame([(1, i, "exit load nil today") for i in range(100)], "p int, o int, t string")
    assert [r.pieces for r in C.merged_if_alike(many, "p", "o", "t", most=50).orderBy("first_order").collect()] == [10] * 10


def test_rebuild_deletes_orphans(spark):
    from tarn.operators import vectors as V

    store = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "old", 1)], "k int, v string, n int")
    current = spark.createDataFrame([(1, "c", 2), (2, "late", 4), (4, "new", 1), (None, "x", 1)], "k int, v string, n int")
    assert sorted((r.k, r.v) for r in V.rebuilt(store, current, ["k"], "n").collect()) == [(1, "c"), (2, "b"), (4, "new")]


def test_pages_without_nodes(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x"), (4, "<script>{"), (5, "<p>" + "word " * 50_000)], "i int, h string")
    got = {r.i: r.nodes for r in N.nodes_of_html(rows, "i", "h").collect()}
    assert got[1] == [] and got[2] == [] and got[3][0].text == "x" and got[4] == [] and len(got[5][0].text) == 249_999
    assert N.faq_entries("[]") == [] and N.faq_entries("{bad") == []


def test_split_is_lossless_and_packing_overlaps():
    text = "One two three. " * 300 + "\n\n" + "x" * 3_000 + " end, of; it? yes! " * 40
    pieces = C.split_recursive(text, 60)
    assert "".join(pieces) == text and all(C.size_of(p) <= 60 for p in pieces if " " in p.strip())
    packed = C.pack(pieces, 200, 40)
    assert all(packed) and sum(map(len, packed)) > len(text)
    assert "".join(C.pack(pieces, 200, 0)) == text
    assert C.split_recursive("", 10) == [] and C.pack([], 10, 2) == []


def test_windows(spark):
    rows = spark.createDataFrame([(1, " ".join(str(i) for i in range(250))), (2, "a b"), (3, " "), (4, None)], "i int, t string")
    got = sorted((r.i, r.window, r.body.split()[0], r.words) for r in C.windows(rows, "i", "t").collect())
    assert got == [(1, 0, "0", 100), (1, 1, "80", 100), (1, 2, "160", 90), (2, 0, "a", 2)]


def test_merge_of_small_neighbours(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "long " * 60), (1, 3, "c"), (2, 0, None)], "p int, o int, t string")
    got = sorted((r.p, r.first_order, r.pieces) for r in C.merged(rows, "p", "o", "t").collect())
    assert got == [(1, 0, 2), (1, 2, 1), (1, 3, 1)]


def test_longest_entity_and_memory(spark):
    names = spark.createDataFrame([("a", "Northbeam Large Cap Fund"), ("b", "Northbeam Large Cap Growth"), ("c", None)], "k string, n string")
    texts = spark.createDataFrame([(1, "is northbeam large cap growth good"), (2, "northbeam large"), (3, "other"), (4, None)], "i int, t string")
    got = sorted((r.i, r.key, r.variant) for r in A.longest_entities(texts, "i", "t", A.name_variants(names, "k", "n")).collect())
    assert got == [(1, "a", "northbeam large cap"), (1, "b", "northbeam large cap growth"), (2, "a", "northbeam large"), (2, "b", "northbeam large")]
    turns = spark.createDataFrame([("c", i, "x" if i == 0 else None) for i in range(13)], "c string, turn int, entity string")
    got = {r.turn: r.context for r in A.remembered(turns, "c", ["turn"], "entity").collect()}
    assert got[10] == "x" and got[11] is None
