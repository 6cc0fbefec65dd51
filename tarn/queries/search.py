"""Queries of vector and term search. Searches take every row whose id is divisible by 100 as a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import lexical as L
from tarn.operators import vectors as V
from tarn.queries.texts import _normalised, _terms
from tarn.session import table

_C = F.col


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(_C("vec_id").alias("id"), _C("embedding").alias("v"), "label")


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(_C("vec_id").alias("q"), _C("embedding").alias("v"), "label")


_INDEXES: dict[tuple[str, str], object] = {}


def _doc_terms(spark, d):
    """The term index of the documents, built once for a session."""
    name = (spark.sparkContext.applicationId, d)
    if name not in _INDEXES:
        _INDEXES[name] = L.kept_index(L.term_sets(table(spark, d, "documents"), "doc_id", "text"))
    return _INDEXES[name]


def _questions(spark, d):
    g = table(spark, d, "golden_set").where("qid is not null and question is not null and cast(substring(qid, 2) as bigint) % 100 = 0")
    return g.groupBy("qid").agg(F.min("question").alias("question")).select(_C("qid").alias("q"), "question")


def _asked(spark, d, expand=False):
    return _questions(spark, d).select("q", (L.expanded(_C("question")) if expand else X.terms(_C("question"))).alias("terms"))


def bm25_topk(spark, d):
    """The ten best documents by BM25 of the questions."""
    return L.bm25(_asked(spark, d), _doc_terms(spark, d), 10).select("q", "id", "score", "rank")


def rrf_fusion(spark, d):
    """Fusion of the rankings of the plain and the expanded question."""
    return L.fuse(_both(spark, d, 20))


def _both(spark, d, k):
    """Rankings of the plain (kind 0) and the expanded questions (kind 1) in one pass."""
    kinds = [_asked(spark, d, wide).select(F.lit(int(wide)).alias("kind"), "q", "terms") for wide in (False, True)]
    return L.rankings(kinds[0].unionByName(kinds[1]), _doc_terms(spark, d), k)


def _coverage(spark, d):
    content = _questions(spark, d).select("q", X.content_terms(_C("question")).alias("content"))
    top = L.bm25(_asked(spark, d), _doc_terms(spark, d), 20)
    rows = top.join(content, "q").join(_doc_terms(spark, d), "id")
    return rows.withColumn("matched", L.coverage(_C("content"), _C("terms"))).withColumn("coverage", F.when(F.size("content") == 0, 0.0).otherwise(F.round(F.size("matched") / F.size("content"), 6)))


def term_coverage(spark, d):
    """The share of the question's content terms that each of the twenty best documents has."""
    return _coverage(spark, d).select("q", "id", "coverage", F.array_join("matched", " ").alias("matched"))


def mmr_diversify(spark, d):
    """Five of the twenty best documents of each question, diversified."""
    pool = L.bm25(_asked(spark, d), _doc_terms(spark, d), 20).join(_doc_terms(spark, d), "id").select("q", "id", "score", "terms")
    return L.diversified(pool, 5)


def _entries(spark, d):
    """(id, text, v): the texts of the retrieved chunks whose vector exists, one for each vector."""
    chunks = table(spark, d, "retrieved_chunks").where("chunk_id is not null and trim(text) <> ''").select("chunk_id", "text")
    files = table(spark, d, "embed_index").where("vector_file is not null").select("chunk_id", "vector_file").distinct()
    vectors = table(spark, d, "chunk_vectors").where(V.is_valid(_C("vector"), 128) & (V.norm(_C("vector")) > 0)).groupBy("vector_file").agg(F.min(F.struct("vec_id", "vector")).alias("x"))
    return chunks.join(files, "chunk_id").join(vectors, "vector_file").groupBy(_C("x.vec_id").alias("id")).agg(F.min("text").alias("text"), F.min("x.vector").alias("v"))


def hybrid_retrieve(spark, d):
    """Five entries for each question by terms and vectors together."""
    questions = _questions(spark, d).select(F.expr("-1 - cast(substring(q, 2) as bigint)").alias("q"), "question")
    return L.retrieved(questions, _entries(spark, d), 5).select((-1 - _C("q")).alias("q"), "id", "pick")


def jaccard_pairs(spark, d):
    """Overlap of the term sets of each question and its ten best documents."""
    top = L.bm25(_asked(spark, d), _doc_terms(spark, d), 10)
    asked = _asked(spark, d).select("q", F.array_distinct("terms").alias("qt"))
    return top.join(asked, "q").join(_doc_terms(spark, d), "id").select("q", "id", F.round(L.jaccard(_C("qt"), _C("terms")), 6).alias("jaccard"))


def clears_gate(spark, d):
    """The retrieved chunks that pass the gate."""
    r = table(spark, d, "retrieved_chunks").distinct()
    return r.where("retrieved_id is not null").select("retrieved_id", L.clears(_C("coverage"), _C("dense_score"), _C("bm25_score")).alias("clears"))


def ooc_reason(spark, d):
    """For questions none of whose chunks pass: the best of them by coverage and BM25."""
    r = table(spark, d, "retrieved_chunks").where("qid is not null").distinct()
    z = lambda c: F.coalesce(_C(c), F.lit(0.0))
    g = r.groupBy("qid").agg(F.max(L.clears(_C("coverage"), _C("dense_score"), _C("bm25_score"))).alias("any"), F.max(F.struct(z("coverage").alias("c"), z("bm25_score").alias("b"), (-_C("retrieved_id")).alias("n"))).alias("best"))
    return g.where("not any").select("qid", (-_C("best.n")).alias("retrieved_id"), F.round("best.c", 6).alias("coverage"), F.round("best.b", 6).alias("bm25"))


def query_expand(spark, d):
    """The questions' terms with synonyms."""
    g = table(spark, d, "golden_set").where("qid is not null and question is not null").select("qid", "question").distinct()
    return g.select("qid", "question", F.array_join(L.expanded(_C("question")), " ").alias("expanded"))


def knn_topk(spark, d):
    return V.nearest(_vector_queries(spark, d), _vectors(spark, d), 5)


def filtered_knn(spark, d):
    return V.nearest(_vector_queries(spark, d), _vectors(spark, d), 5, same_label=True)


def cosine_pairs(spark, d):
    """All vectors at 0.2 or more of the query vectors."""
    return V.within(_vector_queries(spark, d), _vectors(spark, d), 0.2)


def embedding_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(_C("embedding")), 6).alias("norm"))


def l2_normalise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(V.normalised(_C("embedding"))), 6).alias("norm"), F.round(V.normalised(_C("embedding"))[0], 6).alias("first"))


def vector_validity(spark, d):
    v = table(spark, d, "chunk_vectors").where("vec_id is not null")
    return v.groupBy("vec_id").agg(F.max(V.is_valid(_C("vector"), 128)).alias("valid"))


QUERIES = {f.__name__: f for f in (bm25_topk, rrf_fusion, term_coverage, mmr_diversify, hybrid_retrieve, jaccard_pairs, clears_gate, ooc_reason, query_expand, knn_topk, filtered_knn, cosine_pairs, embedding_norms, l2_normalise, vector_validity)}


def _expanded(question: str) -> str:
    base = _normalised(question)
    parts = [_terms(base)] + ["case when regexp_matches(' ' || %s || ' ', '[^a-z0-9]%s[^a-z0-9]') then [%s] else [] end" % (base, p, ", ".join(f"'{w}'" for w in words.split())) for p, words in sorted(L.SYNONYMS, key=lambda s: -len(s[0]))]
    return "flatten([" + ", ".join(parts) + "])"


def _ordered_distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_ASKED = "select qid as q, min(question) as question from golden_set where qid is not null and question is not null and cast(substr(qid, 2) as bigint) % 100 = 0 group by qid"


def _bm25_sql(terms: str, k: int, name: str) -> str:
    """Common table expressions for one ranking; `name` holds (q, id, score, rank)."""
    return f"""
    {name}_w as (select q, term, count(*) as times from (select q, unnest({terms}) as term from asked) group by q, term),
    {name}_s as (select q, id, round(sum(times * w * {L.K1 + 1} / (1 + {L.K1} * (1 - {L.B} + {L.B} * len / mean_len))), 6) as score
        from {name}_w join weights using (term) join postings using (term) group by q, id),
    {name} as (select q, id, score, cast(row_number() over (partition by q order by score desc, id) as integer) as rank from {name}_s where score > 0 qualify rank <= {k})"""


_INDEX = f"""asked as ({_ASKED}),
    docs as (select doc_id as id, list_sort(list_distinct({_terms('text')})) as terms from documents where doc_id is not null and text is not null),
    size as (select count(*) as n, avg(len(terms)) as mean_len from docs),
    postings as (select id, len(terms) as len, unnest(terms) as term from docs),
    idfs as (select term, mean_len, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from postings, size group by term, n, mean_len),
    weights as (select term, mean_len, case when idf < 0 then {L.EPSILON} * (select avg(idf) from idfs) else idf end as w from idfs)"""

_NOISE_TERMS = _normalised("question")
_CONTENT = f"(select q, case when len(k) > 0 then k else a end as content from (select q, a, list_filter(a, lambda x: not list_contains([{', '.join(repr(w) for w in X.NOISE_WORDS)}], x)) as k from (select q, {_terms(_NOISE_TERMS)} as a from asked)))"
_COSINE = "list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[]))"


def _knn_sql(k: int, extra: str = "") -> str:
    return f"""select q, id, sim, cast(row_number() over (partition by q order by sim desc, id) as integer) as rank from (
        select a.vec_id as q, b.vec_id as id, round({_COSINE}, 6) as sim from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id {extra}) qualify rank <= {k}"""


_CLEARS = "(coalesce(coverage, 0) >= 0.5 and (coalesce(dense_score, 0) >= 0.2 or coalesce(bm25_score, 0) >= 1.0))"
ORACLES = {
    "bm25_topk": f"with {_INDEX}, {_bm25_sql(_terms('question'), 10, 'r')} select * from r",
    "rrf_fusion": f"with {_INDEX}, {_bm25_sql(_terms('question'), 20, 'r')}, {_bm25_sql(_ordered_distinct(_expanded('question')), 20, 'x')} select q, id, round(sum(1.0 / ({L.RRF_K} + rank)), 8) as rrf from (select q, id, rank from r union all select q, id, rank from x) group by q, id",
    "term_coverage": f"""with {_INDEX}, {_bm25_sql(_terms('question'), 20, 'r')}, c as {_CONTENT},
        m as (select r.q, r.id, content, list_filter(content, lambda t: list_contains(terms, t) or (length(t) >= 4 and len(list_filter(terms, lambda h: length(h) >= 4 and starts_with(h, t))) > 0)) as matched from r join c using (q) join docs using (id))
        select q, id, case when len(content) = 0 then 0.0 else round(len(matched) / len(content), 6) end as coverage, coalesce(array_to_string(matched, ' '), '') as matched from m""",
    "jaccard_pairs": f"""with {_INDEX}, {_bm25_sql(_terms('question'), 10, 'r')}
        select q, id, round(len(list_intersect(qt, terms)) / len(list_distinct(list_concat(qt, terms))), 6) as jaccard from r join (select q, list_distinct({_terms('question')}) as qt from asked) using (q) join docs using (id)""",
    "clears_gate": f"select retrieved_id, {_CLEARS} as clears from (select distinct * from retrieved_chunks) where retrieved_id is not null",
    "ooc_reason": f"""select qid, retrieved_id, round(coalesce(coverage, 0), 6) as coverage, round(coalesce(bm25_score, 0), 6) as bm25 from (
        select *, bool_or({_CLEARS}) over (partition by qid) as passes, row_number() over (partition by qid order by coalesce(coverage, 0) desc, coalesce(bm25_score, 0) desc, retrieved_id) as n from (select distinct * from retrieved_chunks where qid is not null)) where not passes and n = 1""",
    "query_expand": f"select qid, question, coalesce(array_to_string({_ordered_distinct(_expanded('question'))}, ' '), '') as expanded from (select distinct qid, question from golden_set where qid is not null and question is not null)",
    "knn_topk": _knn_sql(5),
    "filtered_knn": _knn_sql(5, "and a.label = b.label"),
    "cosine_pairs": f"select q, id, sim from ({_knn_sql(50)}) where sim >= 0.2",
    "embedding_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings",
    "l2_normalise": "select vec_id, 1.0 as norm, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first from embeddings",
    "vector_validity": "select vec_id, bool_or(coalesce(len(vector) = 128 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0, false)) as valid from chunk_vectors where vec_id is not null group by vec_id",
}
