import pytest

from tarn.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        same(df, connect(data), ORACLES[name])
    else:
        assert df.count() > 0


def test_columns_of_the_found_queries(spark, data):
    want = {
        "p2_found": ["node_id:bigint"], "p3_found": ["src:string", "rec_id:string", "node_order:int", "kind:string", "char_start:int", "char_end:int"], "p4_found": ["vec_a:bigint", "vec_b:bigint"],
        "p5_found": ["src:string", "item_id:string"], "p6_ids": ["doc_id:bigint", "ids:array<int>"], "p7_found": ["doc_id:bigint", "item_id:bigint"], "p8_found": ["doc_id:bigint"],
    }
    for name, columns in want.items():
        assert [":".join(x) for x in QUERIES[name](spark, data).dtypes] == columns, name


def test_queries_that_must_agree(spark, data):
    """Outputs of one operator in two forms."""
    con = connect(data)
    out = {n: [r.asDict() for r in QUERIES[n](spark, data).collect()] for n in ("p2_found", "p2_main", "p3_found", "p3_masked", "p4_found", "p4_neighbours", "p5_found", "p5_pieces", "p7_found", "p7_clean", "p8_found", "p8_shares")}
    nodes = con.execute("select node_id, page_id from page_nodes where node_id is not null and page_id is not null and trim(coalesce(text, '')) <> '' group by all").fetchall()
    boil = {r["node_id"] for r in out["p2_found"]}
    assert {r["page_id"]: r["n_nodes"] for r in out["p2_main"]} == {p: n for p in {p for _, p in nodes} if (n := sum(q == p and i not in boil for i, q in nodes))}
    items = {}
    for r in out["p3_found"]:
        items.setdefault((r["src"], r["rec_id"], r["node_order"]), []).append(r)
    marks = ("[PERSON]", "[EMAIL]", "[PHONE]", "[ID_NUMBER]", "[ADDRESS]")
    changed = 0
    for r in out["p3_masked"]:
        spans = [x for x in items.get((r["src"], r["rec_id"], r["node_order"]), []) if r["text"][x["char_start"] : x["char_end"]].strip()]
        changed += r["masked"] != r["text"]
        assert sum(r["masked"].count(m) - r["text"].count(m) for m in marks) <= len(spans)
    assert changed == len({k for k in items})
    near = {(r["vec_id"], r["neighbour"]) for r in out["p4_neighbours"] if r["cosine"] >= 0.801}
    pairs = {(r["vec_a"], r["vec_b"]) for r in out["p4_found"]}
    assert {(min(p), max(p)) for p in near} <= pairs
    assert {(r["src"], r["item_id"]) for r in out["p5_pieces"] if r["piece_no"] == 1} == {(r["src"], r["item_id"]) for r in out["p5_found"]}
    leaked = {r["doc_id"] for r in out["p7_found"]}
    assert not leaked & {r["doc_id"] for r in out["p7_clean"]} and len(out["p7_clean"]) + len(leaked) == con.execute("select count(*) from documents").fetchone()[0]
    assert {r["doc_id"] for r in out["p8_shares"] if r["nonprose_share"] > 0.5} == {r["doc_id"] for r in out["p8_found"]}
