"""Queries of the scalar text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.session import table

_C = F.col
#: Text normalisation in SQL; the pieces of the oracles below.
_SQ = f"trim(regexp_replace(text, '{X.BLANKS}+', ' ', 'g'), ' ')"


def _size(text: str) -> str:
    return f"cast(greatest(1, floor(len(regexp_extract_all({text}, '{X.SIZE_TOKEN}')) * 1.3)) as integer)"


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_NOISE = "[" + ", ".join(f"'{w}'" for w in X.NOISE_WORDS) + "]"


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def _questions(spark, d):
    return table(spark, d, "golden_set").where("qid is not null and question is not null").select("qid", "question").distinct()


def _over_docs(**columns):
    return lambda spark, d: _docs(spark, d).select("doc_id", *[make(_C("text")).alias(name) for name, make in columns.items()])


def _over_questions(**columns):
    return lambda spark, d: _questions(spark, d).select("qid", "question", *[make(_C("question")).alias(name) for name, make in columns.items()])


QUERIES = {
    "doc_sha256": _over_docs(sha=lambda t: F.concat(F.lit("sha256:"), F.sha2(t, 256)), short=lambda t: F.substring(F.sha2(t, 256), 1, 6)),
    "doc_content_hash": _over_docs(content_hash=X.content_hash),
    "doc_token_count": _over_docs(tokens=X.size_tokens),
    "doc_whitespace_tokens": _over_docs(n=lambda t: F.size(X.blank_tokens(t)), first=lambda t: F.try_element_at(X.blank_tokens(t), F.lit(1))),
    "text_normalise": _over_docs(squashed=lambda t: F.lower(X.squash(t)), kept=X.squash, tidy=lambda t: F.regexp_replace(X.squash(t), r"[ .\-–—]+$", "")),
    "head_clause": _over_docs(head=X.head_clause),
    "truncate_tokens": _over_docs(short=lambda t: X.truncate_tokens(t, 60)),
    "sentence_count": _over_docs(n=lambda t: F.size(X.sentences(t))),
    "clip_sentences": _over_docs(clipped=lambda t: X.clip_sentences(t, 3)),
    "numbers_in": _over_docs(numbers=lambda t: F.array_join(X.numbers(t), " ")),
    "states_figure": _over_docs(figure=X.states_figure),
    "quote_sentence": _over_docs(quoted=X.quote),
    "collapse_repeats": _over_docs(collapsed=X.collapse_repeats),
    "eval_redact": _over_docs(redacted=X.redact),
    "query_normalise": _over_questions(normalised=X.normalised_question),
    "query_tokenize": _over_questions(terms=lambda t: F.array_join(X.terms(t), " ")),
    "query_content_terms": _over_questions(terms=lambda t: F.array_join(X.content_terms(t), " ")),
    "slugify": lambda spark, d: table(spark, d, "source_list").select("scheme_name").distinct().select("scheme_name", X.slug(_C("scheme_name")).alias("slug")),
    "strip_source_tail": lambda spark, d: _docs(spark, d).select("doc_id", X.without_source_tail(F.concat("text", F.lit(" Source: "), F.coalesce("url", F.lit("https://x.example")))).alias("body")),
    "value_shape_flags": lambda spark, d: table(spark, d, "page_nodes").where("value is not null").select("value").distinct().select("value", X.is_period(_C("value")).alias("period"), X.is_as_on_only(_C("value")).alias("as_on"), X.is_date_only(_C("value")).alias("date_only")),
    "label_value_flags": lambda spark, d: table(spark, d, "page_nodes").where("label is not null").select("label").distinct().select("label", X.is_labelish(_C("label")).alias("labelish"), X.is_valueish(_C("label")).alias("valueish")),
    "label_value_split": lambda spark, d: table(spark, d, "page_nodes").where("node_type = 'table_row' and text is not null").select("text").distinct().select("text", X.label_half(_C("text")).alias("label_half"), X.value_half(_C("text")).alias("value_half")),
    "pii_mask": lambda spark, d: table(spark, d, "source_list").select("scheme_slug").distinct().select("scheme_slug", X.mask(_C("scheme_slug")).alias("masked")),
    "chunk_id": lambda spark, d: _docs(spark, d).select("doc_id", X.chunk_id(F.coalesce("scheme_slug", F.lit("none")), F.coalesce("source", F.lit("")), _C("text")).alias("chunk_id")),
    "iso_timestamp": lambda spark, d: table(spark, d, "fetch_log").where("fetched_at is not null").select("page_id", "fetched_at").distinct().select("page_id", "fetched_at", X.iso(F.to_timestamp("fetched_at")).alias("stamp"), F.date_format(F.to_timestamp("fetched_at"), "yyyy-MM-dd").alias("day")),
    "eval_grounded": lambda spark, d: table(spark, d, "golden_set").where("qid is not null").select("qid", "question", "expected_value").distinct().select("qid", "question", F.when(_C("expected_value") != "", F.contains(X.comparable(F.coalesce("question", F.lit(""))), X.comparable(_C("expected_value")))).alias("grounded")),
}

_Q = "(select distinct qid, question from golden_set where qid is not null and question is not null)"


def _terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: not list_contains({_STOP}, x))"



def _normalised(text: str) -> str:
    out = f"lower(trim(regexp_replace({text}, '{X.BLANKS}+', ' ', 'g'), ' '))"
    for prefix in X.QUESTION_PREFIXES:
        p = prefix.replace("'", "''")
        out = f"regexp_replace({out}, '^{p} *', '')"
    out = f"replace({out}, '_', ' ')"
    out = f"regexp_replace(regexp_replace({out}, '([0-9])\\.([0-9])', '\\1~\\2', 'g'), '([0-9])\\.([0-9])', '\\1~\\2', 'g')"
    return f"trim(regexp_replace(replace(regexp_replace({out}, '[^\\p{{L}}\\p{{M}}\\p{{N}}%~]+', ' ', 'g'), '~', '.'), ' +', ' ', 'g'), ' ')"


_ROW = r"'^(.{2,60}?)\s*[:\-]\s+(.{1,400})$'"
_DOCS = "from documents where text is not null"
ORACLES = {
    "doc_sha256": f"select doc_id, 'sha256:' || sha256(text) as sha, substr(sha256(text), 1, 6) as short {_DOCS}",
    "doc_content_hash": f"select doc_id, sha256({_SQ}) as content_hash {_DOCS}",
    "doc_token_count": f"select doc_id, {_size('text')} as tokens {_DOCS}",
    "doc_whitespace_tokens": f"select doc_id, cast(len(w) as integer) as n, w[1] as first from (select doc_id, list_filter(string_split({_SQ}, ' '), lambda x: x <> '') as w {_DOCS})",
    "text_normalise": f"select doc_id, lower({_SQ}) as squashed, {_SQ} as kept, regexp_replace({_SQ}, '[ .\\-–—]+$', '') as tidy {_DOCS}",
    "head_clause": f"select doc_id, trim(regexp_extract({_SQ}, '^([^.?!]{{0,160}})([.?!]|$)', 1), ' ') as head {_DOCS}",
    "truncate_tokens": f"""
        with w as (select doc_id, text, list_filter(string_split({_SQ}, ' '), lambda x: x <> '') as ws {_DOCS}),
        e as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
        c as (select doc_id, i, word, sum({_size('word')} + 1) over (partition by doc_id order by i) as run from e),
        s as (select doc_id, string_agg(word, ' ' order by i) as short from c where run <= 60 group by doc_id)
        select w.doc_id, case when {_size('w.text')} <= 60 then w.text else coalesce(s.short, '') end as short from w left join s using (doc_id)""",
    "numbers_in": rf"select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')))), ' '), '') as numbers {_DOCS}",
    "states_figure": f"select doc_id, regexp_matches(text, '[₹$%]|[0-9][0-9,]{{2,}}') as figure {_DOCS}",
    "query_normalise": f"select qid, question, {_normalised('question')} as normalised from {_Q}",
    "query_tokenize": f"select qid, question, coalesce(array_to_string({_terms('question')}, ' '), '') as terms from {_Q}",
    "query_content_terms": f"""select qid, question, coalesce(array_to_string(case when len(k) > 0 then k else a end, ' '), '') as terms from (
        select qid, question, a, list_filter(a, lambda x: not list_contains({_NOISE}, x)) as k from (select qid, question, {_terms(_normalised('question'))} as a from {_Q}))""",
    "slugify": "select scheme_name, case when s = '' then 'unknown' else s end as slug from (select distinct scheme_name, regexp_replace(regexp_replace(lower(scheme_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s from source_list)",
    "strip_source_tail": r"select doc_id, trim(regexp_replace(text || ' Source: ' || coalesce(url, 'https://x.example'), '(?i)(\s*Source:\s*https?://\S+)*\s*$', ''), ' ') as body " + _DOCS,
    "value_shape_flags": rf"""select value, regexp_matches(v, '^(1d|1w|1m|3m|6m|1y|2y|3y|5y|10y|all time|ytd|since inception)$') as period,
        regexp_matches(v, '^as (on|of|at) [0-9]{{1,2}} ?[a-z/\-]{{3,12}}\.?,? ?[0-9]{{2,4}}\.?$') as as_on,
        regexp_matches(v, '^[0-9 ]*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ 0-9,''\-/]*$|^[0-9]{{1,2}}[/.\-][0-9]{{1,2}}[/.\-][0-9]{{2,4}}$|^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') as date_only
        from (select distinct value, lower(trim(regexp_replace(value, '{X.BLANKS}+', ' ', 'g'), ' ')) as v from page_nodes where value is not null)""",
    "label_value_split": f"""select text, trim(regexp_extract(t, {_ROW}, 1), ' ') as label_half, trim(regexp_extract(t, {_ROW}, 2), ' ') as value_half
        from (select text, {_SQ} as t from (select distinct text from page_nodes where node_type = 'table_row' and text is not null))""",
    "pii_mask": "select distinct scheme_slug, case when length(scheme_slug) <= 4 then repeat('*', length(scheme_slug)) else substr(scheme_slug, 1, 2) || repeat('*', length(scheme_slug) - 2) end as masked from source_list",
    "chunk_id": f"""select doc_id, coalesce(scheme_slug, 'none') || '__' || substr(case when s = '' then 'unknown' else s end, 1, 40) || '__' || substr(sha256({_SQ}), 1, 6) as chunk_id
        from (select *, regexp_replace(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s {_DOCS})""",
    "iso_timestamp": "select distinct page_id, fetched_at, strftime(cast(replace(replace(fetched_at, 'T', ' '), 'Z', '') as timestamp), '%Y-%m-%dT%H:%M:%S.%gZ') as stamp, substr(fetched_at, 1, 10) as day from fetch_log where fetched_at is not null",
    "label_value_flags": f"""select label, regexp_matches(t, '\\p{{L}}') and not regexp_matches(t, '^[0-9]') and not regexp_matches(lower(t), '{(V := "[₹$%0-9★]|^(n[.]?a[.]?|nil|none|zero|low|moderate|high|very high)$")}') as labelish, regexp_matches(lower(label), '{V}') as valueish
        from (select distinct label, regexp_replace(trim(regexp_replace(label, '{X.BLANKS}+', ' ', 'g'), ' '), '(?i)\\(as on[^)]*\\)', '', 'g') as t from page_nodes where label is not null)""",
}


def _sentence_sql(text: str) -> str:
    body = f"regexp_replace({text}, 'https?://\\S+', '<URL>', 'g')"
    body = f"regexp_replace({body}, '(?i)\\b(mr|mrs|ms|dr|vs|etc|no|fig|approx|incl|excl|min|max|rs|inr|cr|asst|mgr|co|ltd|inc|avg)\\.', '\\1<DOT>', 'g')"
    body = f"regexp_replace({body}, '([0-9])\\.([0-9])', '\\1<DOT>\\2', 'g')"
    return f"list_filter(string_split(regexp_replace({body}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"


ORACLES |= {
    "sentence_count": f"select doc_id, cast(len({_sentence_sql('text')}) as integer) as n {_DOCS}",
    "clip_sentences": f"""select doc_id, case when len({_sentence_sql('text')}) <= 3 then text else trim(array_to_string(list_slice(string_split(regexp_replace(trim(text, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1, 3), ' '), ' ') end as clipped {_DOCS}""",
    "quote_sentence": f"""select doc_id, case when b = '' then '' when regexp_matches(u, '[.!?]$') then u else u || '.' end as quoted from (
        select doc_id, b, upper(substr(b, 1, 1)) || substr(b, 2) as u from (select doc_id, regexp_replace({_SQ}, '^[ .\\-–—]+|[ .\\-–—]+$', '', 'g') as b {_DOCS}))""",
    "eval_redact": rf"select doc_id, regexp_replace(text, '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b|[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+\.[A-Za-z0-9_.]+|[0-9]{{12,}}', '[redacted]', 'g') as redacted {_DOCS}",
}


def _comparable_sql(text: str) -> str:
    t = f"lower({text})"
    for old, new in (("₹", ""), ("rs.", ""), ("rs", ""), (",", ""), ("%", ""), ("cr", " crore ")):
        t = f"replace({t}, '{old}', '{new}')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9. ]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"


ORACLES["eval_grounded"] = f"""select distinct qid, question, case when expected_value <> '' then contains({_comparable_sql("coalesce(question, '')")}, {_comparable_sql('expected_value')}) end as grounded from (select distinct qid, question, expected_value from golden_set where qid is not null)"""
