import re

import pytest

from tarn import queries as core
from tarn.operators import chunking as C
from tarn.operators import scan as S
from tests.oracle import connect, same

QUERIES, ORACLES = core.load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLES[name])


def rows(spark, data, name):
    return QUERIES[name](spark, data).collect()


def texts(data, sql):
    return connect(data).execute(sql).fetchall()


def scan_plainly(text):
    """Spans by priority, by trying every pair."""
    out = []
    for kind, pattern, confidence in S.PATTERNS:
        for m in re.finditer(pattern, text):
            if not any(m.start() < b and a < m.end() for a, b, _, _ in out):
                out.append((m.start(), m.end(), kind, confidence))
    return out


def test_scans_equal_a_plain_loop(spark, data):
    docs = texts(data, "select doc_id, text from documents where text is not null")
    found = {i: scan_plainly(t) for i, t in docs}
    assert {(r.doc_id, r.start, r.stop, r.kind, r.confidence) for r in rows(spark, data, "pii_scan")} == {(i, *x) for i, xs in found.items() for x in xs}
    report = {r.doc_id: r.report for r in rows(spark, data, "pii_report")}
    assert {i: x.count("(high)") + x.count("(low)") for i, x in report.items()} == {i: len(x) for i, x in found.items()} and any(found.values())
    assert {i for i, x in report.items() if x == "clean"} == {i for i, x in found.items() if not x}

    def scrubbed(text, spans):
        for a, b, _, confidence in sorted(spans, reverse=True):
            text = text[:a] + "[REDACTED]" + text[b:] if confidence == "high" else text
        return text

    left = {i for i, t in docs if any(x[3] == "high" for x in scan_plainly(scrubbed(t, found[i])))}
    assert {r.doc_id for r in rows(spark, data, "pii_quarantine")} == left


def test_facts_equal_the_filled_cells(spark, data):
    cells = {(r.page_id, r.fact_key) for r in rows(spark, data, "p1_found")}
    wide = rows(spark, data, "p1_wide")
    keys = [k for (k,) in texts(data, "select distinct fact_key from fact_labels where fact_key is not null")]
    assert cells and {(r.page_id, k) for r in wide for k in keys if r[k] is not None} == cells
    page = dict(texts(data, "select distinct page_id, doc_id from page_nodes where page_id is not null and node_id is not null"))
    want = {}
    for p, k in cells:
        want.setdefault(page[p], set()).add(k)
    have = {r.doc_id: set(r.facts.split()) for r in rows(spark, data, "facts_by_scheme")}
    assert have == want
    named = rows(spark, data, "entity_longest_match")
    asked = dict(texts(data, "select qid, min(question) from golden_set where qid is not null and question is not null group by qid"))
    first = lambda q: next((k for k, p in C.FACT_PATTERNS if re.search(p, " ".join(q.lower().split()))), None)
    lacking = {(r.qid, r.key, first(asked[r.qid])) for r in named if first(asked[r.qid]) and first(asked[r.qid]) not in have.get(r.key, ())}
    assert {(r.qid, r.doc_id, r.fact) for r in rows(spark, data, "unanswerable_fact")} == lacking


def test_prose_chunks_keep_every_word_and_the_cap(spark, data):
    got = {}
    for r in rows(spark, data, "prose_chunks"):
        got.setdefault(r[0], []).append(r)
    name = QUERIES["prose_chunks"](spark, data).columns[0]
    assert name == "doc_id" and got
    for i, text in texts(data, "select doc_id, text from documents where text is not null and trim(text) <> ''"):
        parts = [r.body for r in sorted(got.get(i, []), key=lambda r: r.chunk_index)]
        assert set(re.findall(r"\w+", text)) <= set(re.findall(r"\w+", " ".join(parts))) or not text.strip()
        assert all(r.tokens <= C.CAP + C.OVERLAP for r in got.get(i, []))


def test_collapsed_repeats_equal_a_plain_loop(spark, data):
    docs = dict(texts(data, "select doc_id, text from documents where text is not null"))
    for r in rows(spark, data, "collapse_repeats"):
        assert set(r[1].split()) == set(docs[r.doc_id].split()) and len(r[1]) <= len(docs[r.doc_id])


def test_diversified_answers_come_from_the_pools(spark, data):
    picks = {}
    for r in rows(spark, data, "mmr_diversify"):
        picks.setdefault(r.q, []).append((r.pick, r.id))
    best = {}
    for r in rows(spark, data, "bm25_topk"):
        best.setdefault(r.q, []).append((r.rank, r.id))
    assert set(picks) == set(best)
    for q, found in picks.items():
        assert sorted(p for p, _ in found) == list(range(1, len(found) + 1)) and len({i for _, i in found}) == len(found) <= 5
        assert min(found)[1] == min(best[q])[1]  # the best of all is picked first
    hybrid = {}
    for r in rows(spark, data, "hybrid_retrieve"):
        hybrid.setdefault(r.q, []).append(r.pick)
    assert all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 5 for x in hybrid.values())


def test_told_facts_have_their_units(spark, data):
    cells = {(r.page_id, r.fact_key): r.typed_value for r in rows(spark, data, "p1_found")}
    kinds = dict(texts(data, "select fact_key, min(value_kind) from fact_labels group by fact_key"))
    told = {(r.page_id, r.fact_key): (r.label, r.told) for r in rows(spark, data, "friendly_fact")}
    assert set(told) == set(cells)
    for key, (label, text) in told.items():
        value, kind = cells[key], kinds[key[1]]
        unit = {"percent": "{}%", "price": "₹{}", "rupees": "₹{}", "crore": "₹{} crore", "months": "{} months", "stars": "{} stars"}.get(kind, "{}")
        assert text == unit.format(value) or (value == "1" and text in ("1 month", "1 star"))
        assert label.lower().replace(" ", "_") == key[1].lower() and label[0].isupper()


def test_every_asked_question_has_one_outcome(spark, data):
    got = rows(spark, data, "ask_flow")
    asked = {q for (q,) in texts(data, "select distinct qid from golden_set where qid is not null and question is not null and cast(substr(qid, 2) as bigint) % 100 = 0")}
    assert {r.qid for r in got} == asked and len(got) == len(asked)
    picked = {(f"G{r.q}", r.id) for r in rows(spark, data, "hybrid_retrieve")}
    for r in got:
        assert (r.kind == "answer") == (r.id is not None) == (r.answer is not None)
        assert r.id is None or (f"G{int(r.qid[1:])}", r.id) in picked
        assert r.kind in ("answer", "out_of_corpus") or r.kind.startswith("refused_")


def test_every_query_without_sql_is_tested_by_name():
    here = open(__file__).read()
    assert [n for n in set(QUERIES) - set(ORACLES) if f'"{n}"' not in here] == []


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
