import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import lexical as L
from tarn.operators import vectors as V


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)).round(3)
    x[5] = x[9]
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(300)] + [(300, None, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(5)
    q = df.where("id % 10 = 0").withColumnRenamed("id", "q")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for same in (False, True):
        got = {(a.q, a.rank): a.id for a in V.nearest(q, df, 4, same_label=same).collect()}
        for a in range(0, 300, 10):
            s = (u @ u[a]).round(6)
            order = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != a and (not same or i % 3 == a % 3)][:4]
            assert [got[a, k + 1] for k in range(4)] == order


def test_nearest_without_rows(spark):
    empty = spark.createDataFrame([], "id long, v array<double>, label int")
    assert V.nearest(empty.withColumnRenamed("id", "q"), empty, 3).count() == 0


def test_all_partners_at_a_threshold(spark, monkeypatch):
    from tarn.queries import search

    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    r = np.random.default_rng(2)
    x = r.normal(size=8) + 0.5 * r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(300)] + [(300, None, 0)], "vec_id long, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(search, "table", lambda *_: df)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in (0, 100, 200) for b in range(300) if a != b and round(float(u[a] @ u[b]), 6) >= 0.2}
    assert len(want) > 3 * 50
    rows = search.cosine_pairs(spark, None).collect()
    assert {(r.q, r.id) for r in rows} == want and len(rows) == len(want)


def test_bm25_equals_brute_force(spark):
    docs = {1: "exit load nav", 2: "nav nav nav", 3: "expense ratio and the exit load", 4: "", 5: "load", 6: "nav exit"}
    sets = {i: sorted(set(t for t in d.split() if t not in ("and", "the"))) for i, d in docs.items()}
    n, mean = len(sets), sum(map(len, sets.values())) / len(sets)
    df = Counter(t for s in sets.values() for t in s)
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: (floor if v < 0 else v) for t, v in idf.items()}
    query = ["exit", "load", "load", "ratio", "unseen"]
    want = {i: round(sum(idf[t] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(s) / mean)) for t in query if t in s), 6) for i, s in sets.items()}
    d = L.term_sets(spark.createDataFrame(list(docs.items()) + [(7, None)], "i int, t string"), "i", "t")
    got = {r.id: r.score for r in L.bm25(spark.createDataFrame([("a", query)], "q string, terms array<string>"), d, 10).collect()}
    assert got == {i: pytest.approx(s, abs=1e-6) for i, s in want.items() if s > 0}


def test_diversification_picks_the_other_text(spark):
    pool = spark.createDataFrame([("q", 1, 1.0, ["a", "b"]), ("q", 2, 0.99, ["a", "b"]), ("q", 3, 0.5, ["c"]), ("r", 4, 0.0, None)], "q string, id int, score double, terms array<string>")
    got = [(r.q, r.id) for r in L.diversified(pool, 2).orderBy("q", "pick").collect()]
    assert got == [("q", 1), ("q", 3), ("r", 4)]
    with pytest.raises(ValueError):
        L.diversified(pool, 2, 1.5)


def test_fusion_and_upsert(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "q string, id int, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "q string, id int, rank int")
    got = {r.id: r.rrf for r in L.fuse(a, b).collect()}
    assert got == {1: pytest.approx(1 / 61, abs=1e-8), 2: pytest.approx(1 / 62 + 1 / 61, abs=1e-8)}
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int")
    delta = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, None, 0)], "k int, v string, n int")
    assert sorted((r.k, r.v) for r in V.upserted(base, delta, ["k"], "n").collect()) == [(1, "c"), (2, "b"), (3, None)]
    with pytest.raises(KeyError):
        V.matching(base, {"x": 1}, ("k",))
    assert V.matching(base, {"v": "b"}, ("v",)).count() == 1


def test_retrieval_by_terms_and_vectors(spark):
    """The same steps by loops over a small corpus."""
    r = np.random.default_rng(2)
    words = "exit load nav fund size ratio charge benchmark index units switch".split()
    texts = {i: " ".join(r.choice(words, 5)) + (f" {i}.5%" if i % 3 == 0 else "") for i in range(40)}
    vectors = r.normal(size=(40, 8))
    questions = {-1: "what is the exit load", -2: "nav of the benchmark index", -3: "zzz unseen", -4: None}
    e = spark.createDataFrame([(i, t, vectors[i].tolist()) for i, t in texts.items()], "id long, text string, v array<double>")
    q = spark.createDataFrame(list(questions.items()), "q long, question string")
    got = {}
    for row in L.retrieved(q, e, 5).orderBy("q", "pick").collect():
        got.setdefault(row.q, []).append(row.id)
    sets = {row.id: row.terms for row in L.term_sets(e, "id", "text").collect()}
    asked = {row.q: row for row in q.where("question is not null").select("q", "question", L.expanded(F.col("question")).alias("t"), X.content_terms(F.col("question")).alias("c")).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {}
    for k, row in asked.items():
        frame = spark.createDataFrame([(k, row.t)], "q long, terms array<string>")
        lexical = [(x.id, x.score) for x in L.bm25(frame, spark.createDataFrame(list(sets.items()), "id long, terms array<string>"), 60).orderBy("rank").collect()]
        if not lexical:
            continue
        v = sum(unit[i] for i, _ in lexical[:3])
        sim = np.round(unit @ (v / np.linalg.norm(v)), 6)
        dense = sorted(range(40), key=lambda i: (-sim[i], i))
        score = {}
        for ranking in ([i for i, _ in lexical], dense):
            for n, i in enumerate(ranking, 1):
                score[i] = score.get(i, 0) + 1 / (60 + n)
        by_terms = dict(lexical)
        def covers(i):
            hit = [t for t in row.c if t in sets[i] or (len(t) >= 4 and any(len(h) >= 4 and h.startswith(t) for h in sets[i]))]
            return len(hit) / max(1, len(row.c)) >= 0.5
        asks = any(f" {w} " in f" {row.question} " for w in ("what", "nav"))
        pool = sorted(((-round(round(s, 8) + (0.004 if asks and "%" in texts[i] else 0), 8), i) for i, s in score.items() if covers(i) and (sim[i] >= 0.2 or by_terms.get(i, 0) >= 1.0)))[:20]
        ids = [i for _, i in pool]
        similar = np.array([[len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for b in ids] for a in ids]).round(9)
        want[k] = [ids[p] for p in L.greedy(np.array([-s for s, _ in pool]), similar, 0.35, 5)]
    assert got == want and set(want) == {-1, -2}
