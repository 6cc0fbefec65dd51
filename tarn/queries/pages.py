"""Queries of nodes, chunks and fetches, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import chunking as C
from tarn.operators import nodes as N
from tarn.queries.texts import _size, _terms
from tarn.session import table

_C = F.col


def _nodes(spark, d):
    return N.records(table(spark, d, "page_nodes"))


def _fetches(spark, d):
    return table(spark, d, "fetch_log").distinct()


def _body(spark, d):
    """Node texts of the cleaned documents, copies once."""
    return table(spark, d, "corpus_docs").select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.node_order", "n.node_type", "n.text", "n.label", "n.value").distinct()


def node_dedupe(spark, d):
    return N.deduplicated(_nodes(spark, d)).select("node_id", _C("position").cast("int").alias("position"))


def node_type_pivot(spark, d):
    kinds = ["heading", "paragraph", "list_item", "table_row", "accordion", "quote"]
    return _nodes(spark, d).groupBy("page_id").pivot("node_type", kinds).agg(F.count("node_id")).select("page_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def page_headings(spark, d):
    return _nodes(spark, d).where("node_type = 'heading' and length(trim(text)) between 2 and 160").select("page_id", "node_order", _C("node_level").cast("int").alias("level"), "text")


def page_paragraphs(spark, d):
    return _nodes(spark, d).where("node_type in ('paragraph', 'list_item', 'quote') and length(text) > 60 and length(text) <= 1200").select("node_id", "text")


def page_visible_chars(spark, d):
    have = _nodes(spark, d).groupBy("page_id").agg(F.sum(F.length("text")).alias("chars"))
    said = _fetches(spark, d).groupBy("page_id").agg(F.max("visible_chars").alias("visible_chars"))
    return have.join(said, "page_id", "left").select("page_id", "chars", "visible_chars")


def page_fetch_log(spark, d):
    thin = F.coalesce(_C("visible_chars") < 2000, F.lit(True))
    return _fetches(spark, d).select("page_id", "fetched_at", "ok", "status", thin.alias("thin"))


def page_fetch_summary(spark, d):
    return _fetches(spark, d).groupBy("page_type").agg(F.count("*").alias("fetches"), F.count_if("ok").alias("ok"), F.count_if(~_C("ok")).alias("failed"), F.count_if(F.coalesce(_C("visible_chars") < 2000, F.lit(True))).alias("thin"), F.count_if("from_cache").alias("cached"))


def heading_forward_fill(spark, d):
    return N.with_heading(_nodes(spark, d)).select("node_id", "heading")


def sessionise_sections(spark, d):
    g = N.with_heading(_nodes(spark, d)).groupBy("page_id", "section").agg(F.count("*").alias("nodes"), F.min("node_order").alias("first_order"), F.sum(F.length("text")).alias("chars"))
    return g


def label_value_lookahead(spark, d):
    return N.look_ahead(_nodes(spark, d)).select("node_id", "label_text", "value_text")


def corpus_quality_gate(spark, d):
    return N.quality(_nodes(spark, d))


def clean_pipeline(spark, d):
    """Nodes, nodes after deduplication and facts of every page."""
    n = _nodes(spark, d)
    kept = N.deduplicated(n).groupBy("page_id").agg(F.count("*").alias("kept"))
    facts = C.fact_chunks(n).groupBy("page_id").agg(F.count("*").alias("facts"))
    return n.groupBy("page_id").agg(F.count("*").alias("nodes")).join(kept, "page_id").join(facts, "page_id", "left").select("page_id", "nodes", "kept", F.coalesce("facts", F.lit(0)).alias("facts"))


def corpus_gate_union(spark, d):
    s = table(spark, d, "source_list").distinct()
    pages = s.where("enabled and page_type = 'scheme_page'").select(_C("scheme_slug").alias("doc_id"), "url", "publisher", "page_type")
    rest = s.where("enabled and fetchable and (page_type <> 'scheme_page' or page_type is null)").select(_C("scheme_slug").alias("doc_id"), "url", "publisher", "page_type")
    return pages.unionByName(rest)


def corpus_gate_semi(spark, d):
    known = table(spark, d, "source_list").where("enabled").select(_C("scheme_slug").alias("doc_id")).distinct()
    return _fetches(spark, d).join(F.broadcast(known), "doc_id", "left_semi").select("page_id", "doc_id", "fetched_at")


def snapshot_upsert(spark, d):
    """The latest successful fetch of each document."""
    best = F.max_by(F.struct("page_id", "sha256", "fetched_at"), F.struct("fetched_at", "page_id"))
    return _fetches(spark, d).where("ok and doc_id is not null and fetched_at is not null").groupBy("doc_id").agg(best.alias("s")).select("doc_id", "s.*")


def freshness_filter(spark, d):
    """Fetches less than 24 hours before the latest of their document."""
    f = _fetches(spark, d).where("fetched_at is not null").withColumn("at", F.to_timestamp("fetched_at"))
    last = f.groupBy("doc_id").agg(F.max("at").alias("as_of"))
    return f.join(last, "doc_id").where(F.expr("as_of - at < interval 24 hours")).select("page_id", "doc_id", "fetched_at")


def fact_key_case(spark, d):
    return _nodes(spark, d).where("label is not null").select("label").distinct().select("label", C.fact_key(_C("label")).alias("fact_key"))


def fact_chunks(spark, d):
    return C.fact_chunks(_nodes(spark, d)).select("node_id", "fact_key", "tokens")


def fact_separation(spark, d):
    """The share of facts whose value does not stand in their own text."""
    f = C.fact_chunks(_nodes(spark, d)).where("trim(value) <> ''")
    return f.groupBy("fact_key").agg(F.count("*").alias("facts"), F.round(100 * F.avg((~F.contains(F.lower("text"), F.lower("value"))).cast("double")), 3).alias("separated_pct"))


def fixed_window_chunks(spark, d):
    return C.windows(table(spark, d, "documents"), "doc_id", "text")


def chunk_stats(spark, d):
    """Sizes of the documents' texts by language."""
    t = table(spark, d, "documents").where("text is not null").select("lang", X.size_tokens(_C("text")).alias("n"))
    return t.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


def chunk_validation(spark, d):
    rows = table(spark, d, "embed_index").distinct().join(table(spark, d, "retrieved_chunks").select("chunk_id", "text").distinct(), "chunk_id")
    return C.violations(rows, "chunk_id", "text", "content_hash")


def adjacent_merge(spark, d):
    return C.merged(_body(spark, d), "page_id", "node_order", "text").select("page_id", "first_order", "pieces", F.sha2("body", 256).alias("body_hash"))


def semantic_merge(spark, d):
    """Neighbouring small nodes of one subject merged."""
    return C.merged_if_alike(_body(spark, d), "page_id", "node_order", "text").select("page_id", "first_order", "pieces", F.sha2("body", 256).alias("body_hash"))


def chunk_records(spark, d):
    """Chunk rows of the documents' windows of a hundred words."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "scheme_slug")
    return C.chunk_records(C.windows(table(spark, d, "documents"), "doc_id", "text").join(docs, "doc_id"), doc="doc_id", index="window", body="body", meta=["source", "lang", "scheme_slug"])


def html_badges(spark, d):
    """Labels of nodes, written as pills in a page's header and read back."""
    n = _nodes(spark, d).where("label is not null").select("page_id", "label").distinct()
    pill = F.concat(F.lit("<a href='#'><span>"), F.replace(F.replace(F.replace(_C("label"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</span></a>"))
    pages = n.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set(pill)), "").alias("p"))
    html = pages.select("page_id", F.concat(F.lit("<html><header><div class='x_pills_y'>"), "p", F.lit("</div></header><p>x</p></html>")).alias("html"))
    return N.badges_of_html(html, "page_id", "html").groupBy("page_id").agg(F.count("*").cast("int").alias("badges"))


def prose_chunks(spark, d):
    return C.prose_chunks(table(spark, d, "documents"), "doc_id", "text", cap=330, target=300, overlap=40)


def split_lossless(spark, d):
    """The lengths of the documents' texts, put together again from pieces without overlap."""
    p = C.prose_chunks(table(spark, d, "documents"), "doc_id", "text", cap=200, target=200, overlap=0)
    return p.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("body", X.BLANKS, ""))).alias("chars"))


def html_roundtrip(spark, d):
    """Headings, paragraphs and list entries of the cleaned documents, written as HTML and read back."""
    docs = table(spark, d, "corpus_docs").where("page_id is not null").dropDuplicates(["page_id"])
    plain = F.transform(F.filter("nodes", lambda n: n["node_type"].isin("heading", "paragraph", "list_item") & n["label"].isNull() & (X.squash(n["text"]) != "")), lambda n: F.struct(n["node_type"].alias("node_type"), n["text"].alias("text"), n["node_level"].alias("node_level")))
    back = N.nodes_of_html(docs.select("page_id", N.as_html(plain).alias("html")), "page_id", "html")
    return back.select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.node_type", F.substring("n.text", 1, 160).alias("head"))


_DISTINCT_NODES = "(select distinct * from page_nodes where node_id is not null and page_id is not null)"
_LOG = "(select distinct * from fetch_log)"
_PAGE = "partition by page_id order by node_order, node_id"
_V = "[₹$%0-9★]|^(n[.]?a[.]?|nil|none|zero|low|moderate|high|very high)$"
_SQV = f"lower(trim(regexp_replace(coalesce(value, ''), '{X.BLANKS}+', ' ', 'g'), ' '))"
_SQT = f"trim(regexp_replace(text, '{X.BLANKS}+', ' ', 'g'), ' ')"
_KEY = "case " + " ".join(f"when regexp_matches(lower(trim(regexp_replace(label, '{X.BLANKS}+', ' ', 'g'), ' ')), '{p}') then '{k}'" for k, p in C.FACT_PATTERNS) + " end"
_FACTS = f"""(select *, {_KEY} as fact_key, {_size('text')} as tokens from {_DISTINCT_NODES} where node_type in ('table_row', 'accordion', 'list_item') and label is not null and text is not null
    and not regexp_matches({_SQV}, '^(1d|1w|1m|3m|6m|1y|2y|3y|5y|10y|all time|ytd|since inception)$') and not regexp_matches({_SQV}, '^as (on|of|at) [0-9]{{1,2}} ?[a-z/\\-]{{3,12}}\\.?,? ?[0-9]{{2,4}}\\.?$'))"""
_FACT_ROWS = f"(select * from {_FACTS} where fact_key is not null and tokens between {C.FACT_LEAST} and {C.FACT_TOKENS})"
_FIRST = f"(select *, row_number() over (partition by page_id, node_type, substr(text, 1, 160) order by node_order, node_id) as n from {_DISTINCT_NODES})"

ORACLES = {
    "node_dedupe": f"select node_id, cast(row_number() over ({_PAGE}) - 1 as integer) as position from {_FIRST} where n = 1",
    "node_type_pivot": "select page_id, " + ", ".join(f"count(*) filter (node_type = '{k}') as {k}" for k in ("heading", "paragraph", "list_item", "table_row", "accordion", "quote")) + f" from {_DISTINCT_NODES} group by page_id",
    "page_headings": f"select page_id, node_order, cast(node_level as integer) as level, text from {_DISTINCT_NODES} where node_type = 'heading' and length(trim(text, ' ')) between 2 and 160",
    "page_paragraphs": f"select node_id, text from {_DISTINCT_NODES} where node_type in ('paragraph', 'list_item', 'quote') and length(text) > 60 and length(text) <= 1200",
    "page_visible_chars": f"select page_id, chars, visible_chars from (select page_id, cast(sum(length(text)) as bigint) as chars from {_DISTINCT_NODES} group by page_id) left join (select page_id, max(visible_chars) as visible_chars from {_LOG} group by page_id) using (page_id)",
    "page_fetch_log": f"select page_id, fetched_at, ok, status, coalesce(visible_chars < 2000, true) as thin from {_LOG}",
    "page_fetch_summary": f"select page_type, count(*) as fetches, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, count(*) filter (coalesce(visible_chars < 2000, true)) as thin, count(*) filter (from_cache) as cached from {_LOG} group by page_type",
    "heading_forward_fill": f"select node_id, last_value(case when node_type = 'heading' then text end ignore nulls) over ({_PAGE} rows between unbounded preceding and current row) as heading from {_DISTINCT_NODES}",
    "sessionise_sections": f"select page_id, section, count(*) as nodes, min(node_order) as first_order, cast(sum(length(text)) as bigint) as chars from (select *, cast(sum(case when node_type = 'heading' then 1 else 0 end) over ({_PAGE} rows between unbounded preceding and current row) as integer) as section from {_DISTINCT_NODES}) group by page_id, section",
    "label_value_lookahead": f"""select node_id, text as label_text, found as value_text from (
        select *, first_value(case when length(text) between 1 and 80 and regexp_matches(lower(text), '{_V}') then text end ignore nulls) over ({_PAGE} rows between 1 following and 8 following) as found from {_DISTINCT_NODES})
        where found is not null and length(text) between 1 and 80 and regexp_matches(regexp_replace({_SQT}, '(?i)\\(as on[^)]*\\)', '', 'g'), '\\p{{L}}') and not regexp_matches(regexp_replace({_SQT}, '(?i)\\(as on[^)]*\\)', '', 'g'), '^[0-9]') and not regexp_matches(lower(regexp_replace({_SQT}, '(?i)\\(as on[^)]*\\)', '', 'g')), '{_V}')""",
    "corpus_quality_gate": f"select *, facts > 0 or mean_chars >= 80.0 as kept from (select page_id, count(*) filter (label is not null) as facts, round(avg(length(text)), 6) as mean_chars from {_DISTINCT_NODES} where text is not null group by page_id)",
    "clean_pipeline": f"select page_id, nodes, kept, coalesce(facts, 0) as facts from (select page_id, count(*) as nodes, count(*) filter (n = 1) as kept from {_FIRST} group by page_id) left join (select page_id, count(*) as facts from {_FACT_ROWS} group by page_id) using (page_id)",
    "corpus_gate_union": "select scheme_slug as doc_id, url, publisher, page_type from (select distinct * from source_list) where enabled and (page_type = 'scheme_page' or fetchable)",
    "corpus_gate_semi": f"select page_id, doc_id, fetched_at from {_LOG} where doc_id in (select scheme_slug from source_list where enabled)",
    "snapshot_upsert": f"select doc_id, page_id, sha256, fetched_at from {_LOG} where ok and doc_id is not null and fetched_at is not null qualify row_number() over (partition by doc_id order by fetched_at desc, page_id desc) = 1",
    "freshness_filter": f"select page_id, doc_id, fetched_at from (select *, cast(fetched_at as timestamptz) as t, max(cast(fetched_at as timestamptz)) over (partition by doc_id) as as_of from {_LOG} where fetched_at is not null) where as_of - t < interval 24 hours",
    "fact_key_case": f"select label, {_KEY} as fact_key from (select distinct label from page_nodes where node_id is not null and page_id is not null and label is not null)",
    "fact_chunks": f"select node_id, fact_key, tokens from {_FACT_ROWS}",
    "fact_separation": f"select fact_key, count(*) as facts, round(100 * avg(case when contains(lower(text), lower(value)) then 0.0 else 1.0 end), 3) as separated_pct from {_FACT_ROWS} where trim(value, ' ') <> '' group by fact_key",
    "fixed_window_chunks": f"""with w as (select doc_id, list_filter(string_split({_SQT}, ' '), lambda x: x <> '') as w from documents where text is not null),
        p as (select doc_id, w, cast(unnest(range(0, cast(greatest(0, ceil((len(w) - 20) / 80.0) - 1) as bigint) + 1)) as integer) as k from w where len(w) > 0)
        select doc_id, k as window, array_to_string(list_slice(w, k * 80 + 1, k * 80 + 100), ' ') as body, cast(len(list_slice(w, k * 80 + 1, k * 80 + 100)) as integer) as words from p""",
    "chunk_records": f"""with w as (select doc_id, source, lang, scheme_slug, list_filter(string_split({_SQT}, ' '), lambda x: x <> '') as w from documents where text is not null),
        p as (select *, cast(unnest(range(0, cast(greatest(0, ceil((len(w) - 20) / 80.0) - 1) as bigint) + 1)) as integer) as k from w where len(w) > 0),
        c as (select *, array_to_string(list_slice(w, k * 80 + 1, k * 80 + 100), ' ') as text, cast(len(list_slice(w, k * 80 + 1, k * 80 + 100)) as integer) as words from p)
        select concat_ws('#', cast(doc_id as varchar), 'prose', lpad(cast(k as varchar), 4, '0')) as chunk_id, cast(doc_id as varchar) as doc_id, k as chunk_index, 'prose' as doc_type, text, {_size('text')} as tokens, words, cast(length(text) as integer) as chars, sha256({_SQT}) as content_hash, source, lang, scheme_slug from c""",
    "chunk_stats": f"select lang, count(*) as chunks, round(avg(n), 6) as mean, median(n) as median, min(n) as least, max(n) as most from (select lang, {_size('text')} as n from documents where text is not null) group by lang",
    "chunk_validation": f"""with r as (select * from (select distinct * from embed_index) join (select distinct chunk_id, text from retrieved_chunks) using (chunk_id))
        select 'empty_text' as violation, count(*) filter (coalesce(trim(text, ' '), '') = '') as n from r union all
        select 'hash_mismatch', count(*) filter (content_hash <> sha256({_SQT})) from r union all
        select 'duplicate_id', count(*) from (select chunk_id from r group by chunk_id having count(*) > 1)""",
    "adjacent_merge": f"""with b as (select distinct page_id, n.node_order as node_order, n.node_type as node_type, n.text as text, n.label as label, n.value as value from (select page_id, unnest(nodes) as n from corpus_docs)),
        s as (select *, {_size('text')} < 40 as small from b where text is not null),
        l as (select *, case when small and coalesce(lag(small) over (partition by page_id order by node_order), false) then 0 else 1 end as fresh from s),
        r as (select *, sum(fresh) over (partition by page_id order by node_order rows between unbounded preceding and current row) as run from l)
        select page_id, min(node_order) as first_order, count(*) as pieces, sha256(string_agg(text, ' ' order by node_order)) as body_hash from r group by page_id, run""",
    "semantic_merge": f"""with b as (select distinct page_id, n.node_order as node_order, n.node_type as node_type, n.text as text, n.label as label, n.value as value from (select page_id, unnest(nodes) as n from corpus_docs)),
        s as (select page_id, node_order, text, {_size('text')} as n, list_distinct({_terms('text')}) as t from b where text is not null),
        o as (select *, lag(n) over w as pn, lag(t) over w as pt from s window w as (partition by page_id order by node_order)),
        l as (select *, case when n < 40 and pn < 40 and len(list_distinct(list_concat(t, pt))) > 0 and len(list_intersect(t, pt)) / len(list_distinct(list_concat(t, pt))) >= 0.2 then 0 else 1 end as fresh from o),
        r as (select *, sum(fresh) over (partition by page_id order by node_order rows between unbounded preceding and current row) as run from l),
        p as (select *, floor((sum(n) over (partition by page_id, run order by node_order rows between unbounded preceding and current row) - 1) / {C.CAP}) as part from r)
        select page_id, min(node_order) as first_order, count(*) as pieces, sha256(string_agg(text, ' ' order by node_order)) as body_hash from p group by page_id, run, part""",
    "html_badges": r"""with l as (select distinct page_id, lower(trim(regexp_replace(label, '%s+', ' ', 'g'), ' ')) as t, trim(regexp_replace(label, '%s+', ' ', 'g'), ' ') as label from page_nodes where node_id is not null and page_id is not null and label is not null)
        select page_id, cast(count(distinct t) as integer) as badges from l where length(label) between 1 and 60 and regexp_matches(label, '(?i)lock[-\s]?in|lockin|riskometer|benchmark|expense|exit\s*load|min\.?\s*for|minimum|\bnav\b|\baum\b|stamp\s*duty') group by page_id""" % (X.BLANKS, X.BLANKS),
    "split_lossless": f"select doc_id, cast(length(regexp_replace(text, '{X.BLANKS}', '', 'g')) as bigint) as chars from documents where text is not null and trim(text, ' ') <> '' and length(regexp_replace(text, '{X.BLANKS}', '', 'g')) > 0",
    "html_roundtrip": f"""with x as (select page_id, unnest(nodes) as n from (select distinct on (page_id) page_id, nodes from corpus_docs where page_id is not null)),
        t as (select page_id, n.node_type as node_type, trim(regexp_replace(n.text, '{X.BLANKS}+', ' ', 'g'), ' ') as text, n.node_order as o from x where n.node_type in ('heading', 'paragraph', 'list_item') and n.label is null)
        select distinct page_id, node_type, substr(text, 1, 160) as head from t where text <> ''""",
}
QUERIES = {f.__name__: f for f in (node_dedupe, node_type_pivot, page_headings, page_paragraphs, page_visible_chars, page_fetch_log, page_fetch_summary, heading_forward_fill, sessionise_sections, label_value_lookahead, corpus_quality_gate, clean_pipeline, corpus_gate_union, corpus_gate_semi, snapshot_upsert, freshness_filter, fact_key_case, fact_chunks, fact_separation, fixed_window_chunks, chunk_stats, chunk_validation, adjacent_merge, semantic_merge, chunk_records, html_badges, prose_chunks, split_lossless, html_roundtrip)}
