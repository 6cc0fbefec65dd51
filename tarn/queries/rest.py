"""Queries of scans, rules, stores, answers, evaluation, plain formats and event windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import answers as A
from tarn.operators import lexical as L
from tarn.operators import scan as S
from tarn.operators import vectors as V
from tarn.queries.texts import _SQ, _normalised, _sentence_sql, _terms
from tarn.session import checkpoint_dir, table
from tarn.sources import tables as IO
from tarn.streaming import feeds

_C = F.col


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def _asked(spark, d):
    return table(spark, d, "golden_set").where("qid is not null and question is not null").distinct()


def _chunks(spark, d):
    return table(spark, d, "retrieved_chunks").where("retrieved_id is not null").distinct()


def pii_email_count(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(S.EMAIL)).alias("n"))


def pii_pan_flag(spark, d):
    return _docs(spark, d).select("doc_id", _C("text").rlike(S.PAN).alias("pan"))


def pii_long_digits(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x) >= 12)).alias("n"))


def pii_scrub_email(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_replace("text", S.EMAIL, "[REDACTED]").alias("body"))


def pii_scan(spark, d):
    return S.scanned(_docs(spark, d).select("doc_id", "text"), "text").select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def pii_report(spark, d):
    return S.scanned(_docs(spark, d).select("doc_id", "text"), "text").select("doc_id", S.report(_C("matches")).alias("report"))


def pii_quarantine(spark, d):
    """Documents that still have a match of high confidence after scrubbing."""
    once = S.scanned(_docs(spark, d).select("doc_id", "text"), "text").select("doc_id", S.scrubbed(_C("text"), _C("matches")).alias("body"))
    return S.scanned(once, "body").where(F.exists("matches", lambda m: m["confidence"] == "high")).select("doc_id")


def guard_keyword_hit(spark, d):
    return _asked(spark, d).select("qid", "question", S.keyword_hit(_C("question"), S.RULES[0][1]).alias("hit")).distinct()


def guard_rules(spark, d):
    return _asked(spark, d).select("qid", "question", S.first_rule(_C("question")).alias("kind")).distinct()


def absent_concept(spark, d):
    """Terms of the questions that no document has."""
    terms = _asked(spark, d).select("qid", F.explode(X.content_terms(_C("question"))).alias("term")).distinct()
    have = _docs(spark, d).select(F.explode(F.array_distinct(X.terms(_C("text")))).alias("term")).distinct()
    return terms.join(have, "term", "left_anti").select("qid", "term")


def entity_longest_match(spark, d):
    variants = A.name_variants(table(spark, d, "source_list"), "scheme_slug", "short_name")
    return A.longest_entities(_asked(spark, d).groupBy("qid").agg(F.min("question").alias("question")), "qid", "question", variants)


def conversation_memory(spark, d):
    """The scheme a fetch log's publisher was last seen with: the own one, else the last of ten before."""
    rows = table(spark, d, "fetch_log").where("page_id is not null").distinct()
    rows = rows.withColumn("entity", F.when(_C("ok"), _C("doc_id")))
    return A.remembered(rows, "publisher", ["logged_at", "page_id", "fetched_at"], "entity").select("page_id", "fetched_at", "context")


def grounding(spark, d):
    """Numbers of the questions that none of their chunks states."""
    asked = _asked(spark, d).groupBy("qid").agg(F.min("question").alias("question"))
    return A.missing_numbers(asked, _chunks(spark, d), "qid", "question", "text").select("qid", F.array_join("missing", " ").alias("missing"))


def _ranked(spark, d):
    asked = _asked(spark, d).groupBy("qid").agg(F.min("question").alias("question"))
    return A.best_chunk(_chunks(spark, d).where("text is not null").select("qid", "retrieved_id", "text").join(asked, "qid"), "question", "text", "retrieved_id")


def extraction_rank(spark, d):
    return _ranked(spark, d).select("qid", "retrieved_id", "points", "place")


def extractive_answer(spark, d):
    return _ranked(spark, d).where("place = 1").select("qid", "retrieved_id", A.rendered(_C("text")).alias("answer"))


def render_answer(spark, d):
    return _chunks(spark, d).where("text is not null").select("retrieved_id", A.rendered(_C("text")).alias("answer"))


def validate_answer(spark, d):
    """Faults of the extracted answers: too long, an e-mail in it, or a number its question's chunks do not have."""
    got = extractive_answer(spark, d).join(_chunks(spark, d).select("retrieved_id", "text"), "retrieved_id")
    fault = lambda test, name: F.when(test, F.lit(name))
    return got.select("qid", F.array_join(F.array_compact(F.array(fault(F.size(X.sentences(_C("answer"))) > 3, "too_long"), fault(_C("answer").rlike(S.EMAIL), "pii"), fault(F.size(A.ungrounded(_C("answer"), _C("text"))) > 0, "ungrounded"))), " ").alias("faults"))


def ask_batch(spark, d):
    """One row per question: refused by the first rule, out of the corpus, or answered from its best chunk."""
    asked = _asked(spark, d).groupBy("qid").agg(F.min("question").alias("question")).withColumn("rule", S.first_rule(_C("question")))
    refused = asked.where("rule in ('advice', 'forecast', 'personal')").select("qid", F.concat(F.lit("refused_"), _C("rule")).alias("kind"), F.lit(None).cast("bigint").alias("retrieved_id"))
    open_questions = asked.where("rule not in ('advice', 'forecast', 'personal')")
    passing = _chunks(spark, d).where(L.clears(_C("coverage"), _C("dense_score"), _C("bm25_score")) & _C("text").isNotNull())
    best = passing.groupBy("qid").agg(F.max_by("retrieved_id", F.struct(F.coalesce("final_score", F.lit(0.0)), -_C("retrieved_id"))).alias("retrieved_id"))
    answered = open_questions.join(best, "qid", "left").select("qid", F.when(_C("retrieved_id").isNull(), "out_of_corpus").otherwise("answer").alias("kind"), "retrieved_id")
    return refused.unionByName(answered)


def eval_score(spark, d):
    got = ask_batch(spark, d)
    want = _asked(spark, d).groupBy("qid").agg(F.min("expect_kind").alias("expect_kind"), F.min("category").alias("category"))
    return want.join(got, "qid").select("qid", "category", "kind", (_C("kind") == "answer").alias("answered"), F.when(_C("expect_kind") == "answer", _C("kind") == "answer").alias("kind_ok"))


def eval_summary_rollup(spark, d):
    g = eval_score(spark, d).rollup("category").agg(F.count("*").alias("n"), A.rate(_C("answered")).alias("answered_pct"), A.rate(_C("kind_ok")).alias("ok_pct"), F.grouping("category").cast("int").alias("total"))
    return g


def why_rows(spark, d):
    """The chunks of each question, numbered, with rounded scores and the one that is used."""
    place = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("final_score", F.lit(0.0))), "retrieved_id")
    r = _chunks(spark, d).where("qid is not null").withColumn("n", F.row_number().over(place))
    return r.select("qid", "retrieved_id", "n", F.round("final_score", 4).alias("final"), (_C("n") == 1).alias("used"))


def prompt_context(spark, d):
    """The three best chunks of each question as numbered blocks."""
    top = why_rows(spark, d).where("n <= 3").join(_chunks(spark, d).select("retrieved_id", "text"), "retrieved_id").where("text is not null")
    blocks = F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("["), _C("n").cast("string"), F.lit("] "), _C("text")).alias("b"))))
    return top.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def facts_by_scheme(spark, d):
    from tarn.operators import eav

    long = eav.facts_long(table(spark, d, "page_nodes"), table(spark, d, "fact_labels")).where("readable").select("page_id", "fact_key")
    pages = table(spark, d, "page_nodes").where("page_id is not null and node_id is not null").select("page_id", "doc_id").distinct()
    return long.join(pages, "page_id").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("fact_key")), " ").alias("facts"))


def unanswerable_fact(spark, d):
    """Questions that name a scheme and a fact that no page of the scheme states."""
    from tarn.operators.chunking import fact_key

    asked = _asked(spark, d).groupBy("qid").agg(F.min("question").alias("question"))
    wanted = asked.select("qid", fact_key(_C("question")).alias("fact")).where("fact is not null")
    named = entity_longest_match(spark, d).select("qid", _C("key").alias("doc_id"))
    have = facts_by_scheme(spark, d).select("doc_id", F.explode(F.split("facts", " ")).alias("fact"))
    return wanted.join(named, "qid").join(have, ["doc_id", "fact"], "left_anti").select("qid", "doc_id", "fact")


def source_rollup(spark, d):
    nodes = table(spark, d, "page_nodes").where("page_id is not null").select("page_id", "label").distinct()
    return A.source_rollup(table(spark, d, "fetch_log").where("page_id is not null"), nodes)


def ref_first_per_key(spark, d):
    return table(spark, d, "source_list").where("publisher is not null and url is not null").groupBy("publisher").agg(F.min_by("url", "scheme_slug").alias("url"))


def display_name(spark, d):
    return table(spark, d, "source_list").distinct().select("scheme_slug", F.coalesce(F.nullif(F.trim(F.regexp_replace("scheme_name", r"(?i)\s*[-(]\s*(direct|regular).*$", "")), F.lit("")), _C("short_name"), _C("scheme_slug")).alias("name"))


def coerce_metadata(spark, d):
    return table(spark, d, "source_list").distinct().select("scheme_slug", *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("scheme_name", "publisher", "plan_name")], F.array_join(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()), " | ").alias("aliases"))


def _entity_chunks(spark, d):
    names = table(spark, d, "source_list").distinct().groupBy("scheme_slug").agg(F.min("short_name").alias("short_name"), F.min(F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")).alias("aliases"))
    return _docs(spark, d).join(names, "scheme_slug", "left")


def index_text(spark, d):
    return _entity_chunks(spark, d).select("doc_id", F.concat_ws(" ", "short_name", "aliases", "source", X.squash(_C("text"))).alias("body"))


def embed_text(spark, d):
    return _entity_chunks(spark, d).select("doc_id", X.truncate_tokens(F.concat(F.coalesce("short_name", F.lit("")), F.lit(" - "), X.squash(_C("text"))), 200).alias("body"))


def embed_hash(spark, d):
    return embed_text(spark, d).select("doc_id", X.content_hash(_C("body")).alias("embed_hash"))


def last_updated(spark, d):
    return table(spark, d, "corpus_docs").groupBy("scheme_slug").agg(F.coalesce(F.min(F.substring("source_fetched_at", 1, 10)), F.lit("unknown")).alias("stamp"))


def chunk_vector_join(spark, d):
    e = table(spark, d, "embed_index").where("chunk_id is not null").distinct()
    v = table(spark, d, "chunk_vectors").where("vector_file is not null").groupBy("vector_file").agg(F.min("vec_id").alias("vec_id"), F.max(F.size("vector")).alias("size"))
    return e.join(v, "vector_file").select("chunk_id", "vector_file", "vec_id", (_C("size") == _C("dimension")).alias("fits"))


def embed_cache_misses(spark, d):
    return V.cache_misses(table(spark, d, "embed_index"), table(spark, d, "chunk_vectors"), "vector_file")


def coverage_gaps(spark, d):
    return V.gaps(table(spark, d, "retrieved_chunks"), table(spark, d, "embed_index"), "chunk_id")


def orphan_anti_join(spark, d):
    return table(spark, d, "chunk_vectors").select("vector_file").distinct().join(table(spark, d, "embed_index").select("vector_file").distinct(), "vector_file", "left_anti")


def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    delta = o.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.round(_C("o_totalprice") * 2, 2)).withColumn("o_orderdate", F.expr("o_orderdate + interval 1 day"))
    return V.upserted(o, delta, ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_custkey", "o_totalprice")


def store_rebuild(spark, d):
    """The orders brought to a state without every fifth key and with other prices for every seventh."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    current = o.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.when(_C("o_orderkey") % 7 == 0, F.round(_C("o_totalprice") * 2, 2)).otherwise(_C("o_totalprice")))
    return V.rebuilt(o, current, ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_custkey", "o_totalprice")


def ask_flow(spark, d):
    """One row per question (qid divisible by 100): refused by a rule, out of the corpus, or answered from what retrieval finds.

    The answer is the retrieved entry of the most extraction points, then the earlier pick, as text with its entry's id.
    """
    from tarn.queries import search

    asked = _asked(spark, d).groupBy("qid").agg(F.min("question").alias("question")).where("cast(substring(qid, 2) as bigint) % 100 = 0").withColumn("rule", S.first_rule(_C("question")))
    refused = _C("rule").isin("advice", "forecast", "personal")
    picks = search.hybrid_retrieve(spark, d).select(F.concat(F.lit("G"), _C("q").cast("string")).alias("_q"), "id", "pick").join(search._entries(spark, d).select("id", "text"), "id")
    number = F.concat(F.lit("G"), F.substring("qid", 2, 20).cast("bigint").cast("string"))
    points = asked.where(~refused).withColumn("_q", number).join(picks, "_q").withColumn("points", F.round(A.extraction_score(_C("question"), _C("text")), 6))
    best = points.groupBy("qid").agg(F.max_by(F.struct("id", "text"), F.struct("points", -_C("pick"))).alias("b"))
    kind = F.when(refused, F.concat(F.lit("refused_"), _C("rule"))).when(_C("b").isNull(), "out_of_corpus").otherwise("answer")
    return asked.join(best, "qid", "left").select("qid", kind.alias("kind"), _C("b.id").alias("id"), A.rendered(_C("b.text")).alias("answer"))


def store_stats_grouping_sets(spark, d):
    t = table(spark, d, "documents")
    return t.groupingSets([[_C("lang")], [_C("source")]], "lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def _folder(spark):
    return f"{checkpoint_dir(spark)}/tarn-{uuid.uuid4().hex[:12]}"


def io_jsonl_roundtrip(spark, d):
    n = table(spark, d, "nation")
    path = _folder(spark)
    IO.write_json_lines(n, path)
    return IO.read_json_lines(spark, path, n.schema)


def io_csv_roundtrip(spark, d):
    g = table(spark, d, "golden_set").select("qid", "category", "expect_kind")
    path = _folder(spark)
    IO.write_csv(g, path)
    return IO.read_csv(spark, path, g.schema, key="qid")


def events_windowed(spark, d):
    return feeds.windowed(table(spark, d, "events"))


def events_sessions(spark, d):
    return feeds.sessions(table(spark, d, "events"))


def stream_windowed(spark, d):
    """The same windows from a stream of the events' file, every row in time."""
    events = table(spark, d, "events")
    name = f"w{uuid.uuid4().hex[:12]}"
    import os

    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet" if os.path.isfile(f"{d}/events.parquet") else "*.parquet").parquet(d if os.path.isfile(f"{d}/events.parquet") else f"{d}/events.parquet")
    out = _folder(spark)
    rows = feeds.windowed(stream, late="36500 days")
    q = rows.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


_NAMES = """pii_email_count pii_pan_flag pii_long_digits pii_scrub_email pii_scan pii_report pii_quarantine guard_keyword_hit guard_rules absent_concept entity_longest_match conversation_memory grounding
extraction_rank extractive_answer render_answer validate_answer ask_batch eval_score eval_summary_rollup why_rows prompt_context facts_by_scheme unanswerable_fact source_rollup ref_first_per_key display_name coerce_metadata
index_text embed_text embed_hash last_updated chunk_vector_join embed_cache_misses coverage_gaps orphan_anti_join upsert_latest store_rebuild ask_flow store_stats_grouping_sets io_jsonl_roundtrip io_csv_roundtrip events_windowed events_sessions stream_windowed""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_D = "from documents where text is not null"
_A = "(select distinct * from golden_set where qid is not null and question is not null)"
_ONE = f"(select qid, min(question) as question from {_A} group by qid)"
_CH = "(select distinct * from retrieved_chunks where retrieved_id is not null)"


def _hit(text: str, words) -> str:
    return "coalesce(" + ", ".join(f"case when regexp_matches(' ' || lower({text}) || ' ', '[^a-z0-9]{w}[^a-z0-9]') then '{w}' end" for w in words) + ")"


def _rule(text: str) -> str:
    return "coalesce(" + ", ".join(f"case when {_hit(text, words)} is not null then '{name}' end" for name, words in S.RULES) + ", 'open')"


def _content(text: str) -> str:
    a = _terms(_normalised(text))
    noise = "[" + ", ".join(f"'{w}'" for w in X.NOISE_WORDS) + "]"
    k = f"list_filter({a}, lambda x: not list_contains({noise}, x))"
    return f"(case when len({k}) > 0 then {k} else {a} end)"


def _numbers(text: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({text}, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')))"


_ROWRE = r"'^(.{2,60}?)\s*[:\-]\s+(.{1,400})$'"
_LABEL, _VALUE = (f"trim(regexp_extract({_SQ}, {_ROWRE}, {i}), ' ')" for i in (1, 2))
_CLEARS = "(coalesce(coverage, 0) >= 0.5 and (coalesce(dense_score, 0) >= 0.2 or coalesce(bm25_score, 0) >= 1.0))"
_DATE = r"'^[0-9 ]*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ 0-9,''\-/]*$|^[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"
_RANK = f"""(select *, cast(row_number() over (partition by qid order by points desc, retrieved_id) as integer) as place from (
    select qid, retrieved_id, text, round(len(list_intersect({_content('question')}, list_distinct({_terms('text')}))) * 1.5 + case when {_LABEL} <> '' then 1.0 else 0.0 end - case when regexp_matches(lower({_VALUE}), {_DATE}) then 2.0 else 0.0 end, 6) as points
    from (select qid, retrieved_id, text from {_CH} where text is not null) join {_ONE} using (qid)))"""
_CLIP = f"case when len({_sentence_sql('text')}) <= 2 then text else trim(array_to_string(list_slice(string_split(regexp_replace(trim(text, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 2), ' '), ' ') end"


def _quoted(text: str) -> str:
    b = f"regexp_replace(trim(regexp_replace({text}, '{X.BLANKS}+', ' ', 'g'), ' '), '^[ .\\-–—]+|[ .\\-–—]+$', '', 'g')"
    u = f"(upper(substr({b}, 1, 1)) || substr({b}, 2))"
    return f"case when {b} = '' then '' when regexp_matches({u}, '[.!?]$') then {u} else {u} || '.' end"


_RENDER = _quoted(f"(case when {_LABEL} <> '' and length(text) <= 120 then upper(substr({_LABEL}, 1, 1)) || substr({_LABEL}, 2) || ': ' || {_VALUE} else {_CLIP} end)")
_ANSWER = f"(select qid, retrieved_id, text, {_RENDER} as answer from {_RANK} where place = 1)"
_ASK = f"""(with a as (select qid, question, {_rule('question')} as rule from {_ONE}),
    b as (select qid, retrieved_id from {_CH} where {_CLEARS} and text is not null qualify row_number() over (partition by qid order by coalesce(final_score, 0) desc, retrieved_id) = 1)
    select qid, case when rule in ('advice', 'forecast', 'personal') then 'refused_' || rule when b.retrieved_id is null then 'out_of_corpus' else 'answer' end as kind, case when rule not in ('advice', 'forecast', 'personal') then b.retrieved_id end as retrieved_id from a left join b using (qid))"""
_SCORE = f"(select qid, category, kind, kind = 'answer' as answered, case when expect_kind = 'answer' then kind = 'answer' end as kind_ok from (select qid, min(expect_kind) as expect_kind, min(category) as category from {_A} group by qid) join {_ASK} using (qid))"
_WHY = f"(select qid, retrieved_id, cast(row_number() over (partition by qid order by coalesce(final_score, 0) desc, retrieved_id) as integer) as n, round(final_score, 4) as final, text from {_CH} where qid is not null)"
_NAMED = "(select scheme_slug, min(short_name) as short_name, min(coalesce(array_to_string(aliases, ' '), '')) as aliases from source_list group by scheme_slug)"


def _size(text: str) -> str:
    return f"cast(greatest(1, floor(len(regexp_extract_all({text}, '{X.SIZE_TOKEN}')) * 1.3)) as integer)"


_EMBED = f"""(with t as (select doc_id, coalesce(short_name, '') || ' - ' || {_SQ} as text from documents left join {_NAMED} using (scheme_slug) where text is not null),
    w as (select doc_id, text, list_filter(string_split({_SQ}, ' '), lambda x: x <> '') as ws from t),
    e as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
    c as (select doc_id, i, word, sum({_size('word')} + 1) over (partition by doc_id order by i) as run from e),
    s as (select doc_id, string_agg(word, ' ' order by i) as short from c where run <= 200 group by doc_id)
    select w.doc_id, case when {_size('w.text')} <= 200 then w.text else coalesce(s.short, '') end as body from w left join s using (doc_id))"""

ORACLES = {
    "pii_email_count": f"select doc_id, cast(len(regexp_extract_all(text, '{S.EMAIL}')) as integer) as n {_D}",
    "pii_pan_flag": f"select doc_id, regexp_matches(text, '{S.PAN}') as pan {_D}",
    "pii_long_digits": f"select doc_id, cast(len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) >= 12)) as integer) as n {_D}",
    "pii_scrub_email": f"select doc_id, regexp_replace(text, '{S.EMAIL}', '[REDACTED]', 'g') as body {_D}",
    "guard_keyword_hit": f"select distinct qid, question, {_hit('question', S.RULES[0][1])} as hit from {_A}",
    "guard_rules": f"select distinct qid, question, {_rule('question')} as kind from {_A}",
    "absent_concept": f"select distinct qid, term from (select qid, unnest({_content('question')}) as term from {_A}) where term not in (select distinct unnest({_terms('text')}) {_D})",
    "entity_longest_match": f"""with n as (select distinct scheme_slug as key, {_terms('short_name')} as w from source_list where scheme_slug is not null and short_name is not null),
        v as (select distinct key, array_to_string(list_slice(w, 1, k), ' ') as variant from (select key, w, unnest(range(2, len(w) + 1)) as k from n) where length(array_to_string(list_slice(w, 1, k), ' ')) >= 6),
        q as (select qid, ' ' || array_to_string({_terms('question')}, ' ') || ' ' as t from {_ONE})
        select qid, key, max_by(variant, length(variant)) as variant from q join v on contains(t, ' ' || variant || ' ') group by qid, key""",
    "conversation_memory": """select page_id, fetched_at, coalesce(entity, last_value(entity ignore nulls) over (partition by publisher order by logged_at nulls first, page_id, fetched_at nulls first rows between 10 preceding and 1 preceding)) as context
        from (select *, case when ok then doc_id end as entity from (select distinct * from fetch_log where page_id is not null))""",
    "grounding": f"""select qid, coalesce(array_to_string(case when context is null then [] else list_sort(list_filter({_numbers('question')}, lambda x: not list_contains({_numbers('context')}, x))) end, ' '), '') as missing
        from {_ONE} left join (select qid, string_agg(text, ' ' order by text) as context from {_CH} where text is not null group by qid) using (qid)""",
    "extraction_rank": f"select qid, retrieved_id, points, place from {_RANK}",
    "extractive_answer": f"select qid, retrieved_id, answer from {_ANSWER}",
    "render_answer": f"select retrieved_id, {_RENDER} as answer from {_CH} where text is not null",
    "validate_answer": f"""select qid, coalesce(array_to_string(list_filter([case when len({_sentence_sql('answer')}) > 3 then 'too_long' end, case when regexp_matches(answer, '{S.EMAIL}') then 'pii' end,
        case when len(list_filter({_numbers('answer')}, lambda x: not list_contains({_numbers('text')}, x))) > 0 then 'ungrounded' end], lambda x: x is not null), ' '), '') as faults from {_ANSWER}""",
    "ask_batch": f"select * from {_ASK}",
    "eval_score": f"select * from {_SCORE}",
    "eval_summary_rollup": f"select category, count(*) as n, round(100 * avg(cast(answered as integer)), 1) as answered_pct, round(100 * avg(cast(kind_ok as integer)), 1) as ok_pct, cast(grouping(category) as integer) as total from {_SCORE} group by rollup (category)",
    "why_rows": f"select qid, retrieved_id, n, final, n = 1 as used from {_WHY}",
    "prompt_context": f"select qid, string_agg('[' || n || '] ' || text, chr(10) || chr(10) order by n) as context from {_WHY} where n <= 3 and text is not null group by qid",
    "source_rollup": "select publisher, count(distinct page_id) as pages, cast(count(distinct label) as integer) as labels from (select distinct page_id, publisher from fetch_log where page_id is not null) left join (select distinct page_id, label from page_nodes where page_id is not null and label is not null) using (page_id) group by publisher",
    "ref_first_per_key": "select publisher, min_by(url, scheme_slug) as url from source_list where publisher is not null and url is not null group by publisher",
    "display_name": r"select distinct scheme_slug, coalesce(nullif(trim(regexp_replace(scheme_name, '(?i)\s*[-(]\s*(direct|regular).*$', ''), ' '), ''), short_name, scheme_slug) as name from source_list",
    "coerce_metadata": "select distinct scheme_slug, coalesce(trim(scheme_name, ' '), '') as scheme_name, coalesce(trim(publisher, ' '), '') as publisher, coalesce(trim(plan_name, ' '), '') as plan_name, coalesce(array_to_string(list_filter(aliases, lambda a: a is not null), ' | '), '') as aliases from source_list",
    "index_text": f"select doc_id, concat_ws(' ', short_name, aliases, source, {_SQ}) as body from documents left join {_NAMED} using (scheme_slug) where text is not null",
    "embed_text": f"select * from {_EMBED}",
    "embed_hash": f"select doc_id, sha256(trim(regexp_replace(body, '{X.BLANKS}+', ' ', 'g'), ' ')) as embed_hash from {_EMBED}",
    "last_updated": "select scheme_slug, coalesce(min(substr(source_fetched_at, 1, 10)), 'unknown') as stamp from corpus_docs group by scheme_slug",
    "chunk_vector_join": "select chunk_id, vector_file, vec_id, size = dimension as fits from (select distinct * from embed_index where chunk_id is not null) join (select vector_file, min(vec_id) as vec_id, max(len(vector)) as size from chunk_vectors where vector_file is not null group by vector_file) using (vector_file)",
    "embed_cache_misses": "select distinct vector_file from embed_index where vector_file is not null and vector_file not in (select vector_file from chunk_vectors where vector_file is not null)",
    "coverage_gaps": "select distinct chunk_id, 'missing' as state from retrieved_chunks where chunk_id is not null and chunk_id not in (select chunk_id from embed_index where chunk_id is not null) union all select distinct chunk_id, 'orphan' from embed_index where chunk_id is not null and chunk_id not in (select chunk_id from retrieved_chunks where chunk_id is not null)",
    "orphan_anti_join": "select distinct vector_file from chunk_vectors v where not exists (select 1 from embed_index e where e.vector_file = v.vector_file)",
    "upsert_latest": "select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then round(o_totalprice * 2, 2) else o_totalprice end as o_totalprice from orders",
    "store_rebuild": "select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then round(o_totalprice * 2, 2) else o_totalprice end as o_totalprice from orders where o_orderkey % 5 <> 0",
    "store_stats_grouping_sets": "select lang, source, count(*) as n, cast(grouping(lang, source) as integer) as level from documents group by grouping sets ((lang), (source))",
    "io_jsonl_roundtrip": "select * from nation",
    "io_csv_roundtrip": "select qid, category, expect_kind from golden_set where qid is not null and trim(qid, ' ') <> ''",
    "events_windowed": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_windowed": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sessions": "select user_id, min(ts) as start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as fresh from events)) group by user_id, s",
}
