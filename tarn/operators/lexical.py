"""Term search: postings, BM25 over term sets, query expansion, coverage, fusion of rankings and diversification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import vectors as V
from tarn.session import kept

#: The public BM25 defaults, the constant of reciprocal rank fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Question terms that are broadcast to the documents' terms; beyond it they are joined by a shuffle.
BROADCAST_TERMS = 200_000

#: Our own synonyms of frequent question words: phrase, terms to add.
SYNONYMS = (("ter", "expense ratio charges"), ("expense ratio", "ter charges"), ("sip", "instalment monthly"), ("nav", "net asset value"), ("aum", "fund size assets"), ("lock in", "holding period"), ("exit load", "redemption charge"), ("riskometer", "risk level"))


def term_sets(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, terms): the sorted set of terms of each text; texts without a term have an empty one."""
    return docs.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("id"), F.array_sort(F.array_distinct(X.terms(F.col(text)))).alias("terms"))


def kept_index(docs: DataFrame) -> DataFrame:
    """The term index: (id, terms, len) as a table in the shared folder, so that texts are tokenised once for all rankings."""
    return kept(docs.select("id", "terms", F.size("terms").alias("len")))


def rankings(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(kind, q, id, score, rank): the k best entries of the index for each query (kind, q, terms), scores above 0 only.

    Entries are sets of terms, so a term counts once; repeated query terms count repeatedly. A negative idf is
    replaced by EPSILON times the mean idf of all terms. Frequencies and lengths are over all entries. The asked terms
    with their weights are broadcast to the entries if they are few (BROADCAST_TERMS), so entries are not shuffled;
    beyond that they meet by a shuffle. All kinds of queries share one pass. Ties go to the smaller id.
    """
    wanted = queries.select("kind", "q", F.explode("terms").alias("term")).groupBy("kind", "q", "term").agg(F.count("*").alias("times"))
    few = F.broadcast if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda x: x)
    one = lambda df: F.broadcast(df.withColumn("_j", F.lit(1)))  # noqa: E731  (one row)
    size = index.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("_j", F.lit(1))
    idf = df.join(one(size), "_j").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    weights = idf.join(one(idf.agg(F.avg("idf").alias("mean_idf"))), "_j").select("term", "mean_len", F.when(F.col("idf") < 0, F.lit(EPSILON) * F.col("mean_idf")).otherwise(F.col("idf")).alias("w"))
    asked = wanted.join(weights, "term")
    hits = index.select("id", "len", F.explode("terms").alias("term")).join(few(asked), "term")
    part = F.col("times") * F.col("w") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    scores = hits.groupBy("kind", "q", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rank): the k best documents of (id, terms) for each query (q, terms), as by rankings."""
    index = docs if "len" in docs.columns else docs.withColumn("len", F.size("terms"))
    return rankings(queries.select(F.lit(0).alias("kind"), "q", "terms"), index, k).drop("kind")


def expanded(question: Column) -> Column:
    """The question's terms and those of the synonyms it names as whole phrases (longest phrase first), each once."""
    base = X.normalised_question(question)
    padded = F.concat(F.lit(" "), base, F.lit(" "))
    extra = [F.when(padded.rlike(f"[^a-z0-9]{phrase}[^a-z0-9]"), F.array(*[F.lit(w) for w in words.split()])).otherwise(F.array().cast("array<string>")) for phrase, words in sorted(SYNONYMS, key=lambda s: -len(s[0]))]
    return F.array_distinct(F.concat(X.terms(base), *extra))


def coverage(terms: Column, doc_terms: Column) -> Column:
    """The terms found in the document, exactly or (four letters or more on both sides) as the beginning of one of its terms."""
    return F.filter(terms, lambda t: F.array_contains(doc_terms, t) | ((F.length(t) >= 4) & F.exists(doc_terms, lambda h: (F.length(h) >= 4) & F.startswith(h, t))))


def fuse(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(q, id, rrf): reciprocal rank fusion of rankings (q, id, rank from 1)."""
    every = rankings[0].select("q", "id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("q", "id", "rank"))
    return every.groupBy("q", "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 8).alias("rrf"))


def clears(coverage: Column, dense: Column, lexical: Column, *, least=(0.5, 0.20, 1.0)) -> Column:
    """Enough coverage, and enough similarity or lexical score; null scores count as 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return (z(coverage) >= least[0]) & ((z(dense) >= least[1]) | (z(lexical) >= least[2]))


def greedy(relevance: np.ndarray, similar: np.ndarray, weight: float, k: int) -> list[int]:
    """Picks in order: each maximises weight * relevance - (1 - weight) * similarity to what is picked; first wins ties."""
    top = np.abs(relevance).max() or 1.0
    gain = weight * np.abs(relevance) / top
    picked: list[int] = []
    worst = np.zeros(len(relevance))
    for _ in range(min(k, len(relevance))):
        score = gain - (1 - weight) * worst
        score[picked] = -np.inf
        best = int(np.argmax(score))
        picked.append(best)
        worst = np.maximum(worst, similar[best]) if len(picked) > 1 else similar[best].copy()
    return picked


def diversified(pool: DataFrame, k: int, weight: float = 0.35) -> DataFrame:
    """(q, id, pick): maximal marginal relevance over pools (q, id, score, terms), alike by the overlap of their terms.

    A pool is what a search kept for one query (tens of rows); one query's pool goes to one task.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the weight lies between 0 and 1")
    id_type = pool.schema["id"].dataType.simpleString()
    q_type = pool.schema["q"].dataType.simpleString()

    def run(table):
        order = sorted(range(table.num_rows), key=lambda i: (-table.column("score")[i].as_py(), table.column("id")[i].as_py()))
        terms = [set(table.column("terms")[i].as_py() or ()) for i in order]
        n = len(order)
        similar = np.array([[len(a & b) / len(a | b) if a | b else 0.0 for b in terms] for a in terms]).round(9)
        picks = greedy(np.array([table.column("score")[i].as_py() for i in order]), similar, weight, k)
        return pa.table({"q": table.column("q").take(pa.array([0] * len(picks), pa.int64())), "id": table.column("id").take(pa.array([order[p] for p in picks], pa.int64())), "pick": pa.array(range(1, len(picks) + 1), pa.int32())}) if n else pa.table({})

    return pool.groupBy("q").applyInArrow(run, f"q {q_type}, id {id_type}, pick int")


#: Candidates of each ranking, best entries by terms that stand for a question's vector, and entries that are diversified.
CANDIDATES, FEEDBACK, POOL = 60, 3, 20
#: What an entry with a figure gains if the question asks for one.
FIGURE_BOOST = 0.004


def question_vectors(lexical: DataFrame, entries: DataFrame) -> DataFrame:
    """(q, v): the mean direction of the FEEDBACK best entries by terms, which stands for a question without an encoder."""
    best = lexical.where(F.col("rank") <= FEEDBACK).join(entries.select("id", "v"), "id").select("q", "rank", V.normalised(F.col("v")).alias("v"))
    listed = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("x"))  # FEEDBACK at most
    total = F.aggregate(F.slice("x", 2, FEEDBACK), F.col("x")[0]["v"], lambda s, e: F.zip_with(s, e["v"], lambda a, b: a + b))
    return listed.select("q", total.alias("v"))


def retrieved(questions: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(q, id, pick): k entries (id, text, v) for each question (q, question), by terms and by vectors.

    Ranked by the expanded question's terms and by the cosine to the question's vector, fused by reciprocal ranks;
    an entry that states a figure gains a little where the question asks for one; what covers too little of the
    question is left out; the best POOL are diversified. A question without a hit by terms has no row. q and id are
    numbers, and no q may equal an id.
    """
    rows = kept(entries.where("id is not null and text is not null").select("id", "text", "v", F.array_sort(F.array_distinct(X.terms(F.col("text")))).alias("terms")).withColumn("len", F.size("terms")))
    asked = questions.where("q is not null and question is not null").select("q", "question", expanded(F.col("question")).alias("terms"), X.content_terms(F.col("question")).alias("content"))
    lexical = kept(bm25(asked.select("q", "terms"), rows.select("id", "terms", "len"), CANDIDATES))
    dense = V.nearest(question_vectors(lexical, rows), rows.select("id", "v"), CANDIDATES)
    both = fuse(lexical, dense).join(lexical.select("q", "id", "score"), ["q", "id"], "left").join(dense.select("q", "id", "sim"), ["q", "id"], "left")
    full = both.join(asked.select("q", "question", "content"), "q").join(rows.select("id", "text", "terms"), "id")
    share = F.size(coverage(F.col("content"), F.col("terms"))) / F.greatest(F.size("content"), F.lit(1))
    asks = F.lower("question").rlike("(^|[^a-z0-9])(what|which|how much|how many|give|tell|expense ratio|ter|aum|nav|size|charge)([^a-z0-9]|$)")
    final = F.round(F.col("rrf") + F.when(X.states_figure(F.col("text")) & asks, FIGURE_BOOST).otherwise(0.0), 8)
    passing = full.where(clears(share, F.col("sim"), F.col("score"))).select("q", "id", final.alias("score"), "terms")
    pool = passing.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_r") <= POOL)
    return diversified(pool.drop("_r"), k)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two term sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
