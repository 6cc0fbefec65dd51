"""Queries of single rules, labels and JSON-LD entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import eav
from tarn.operators import nodes as N
from tarn.operators import scan as S
from tarn.queries.rest import _A, _asked, _hit
from tarn.session import table

_C = F.col


def _rule(words):
    return lambda spark, d: _asked(spark, d).select("qid", "question", S.keyword_hit(_C("question"), words).isNotNull().alias("hit")).distinct()


def friendly_value(spark, d):
    """Readable names of the fact keys, and percentages with their sign."""
    t = table(spark, d, "fact_labels").select("fact_key", "value_kind").distinct()
    return t.select("fact_key", F.concat(F.upper(F.substring("fact_key", 1, 1)), F.substring(F.replace("fact_key", F.lit("_"), F.lit(" ")), 2, 100)).alias("label"), F.when(_C("value_kind") == "percent", "1.5%").otherwise("1.5").alias("sample"))


#: Our own generic list of things a question asks to be done rather than told.
ACTIONS = ("open an account", "close my account", "change my address", "transfer", "redeem for me", "invest for me", "book an order", "block", "cancel", "switch my units", "send me", "call me", "on behalf of")


def friendly_fact(spark, d):
    """The readable facts of each page as they would be told: a name in plain words and the value with its unit."""
    long = eav.facts_long(table(spark, d, "page_nodes"), table(spark, d, "fact_labels")).where("readable")
    name = F.replace("fact_key", F.lit("_"), F.lit(" "))
    k, v = _C("value_kind"), _C("typed_value")
    value = F.when(k == "percent", F.concat(v, F.lit("%"))).when(k.isin("price", "rupees"), F.concat(F.lit("₹"), v)).when(k == "crore", F.concat(F.lit("₹"), v, F.lit(" crore"))).when(k.isin("months", "stars"), F.concat(v, F.lit(" "), F.when(v == "1", F.regexp_replace(k, "s$", "")).otherwise(k))).otherwise(v)
    return long.select("page_id", "fact_key", F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 200)).alias("label"), value.alias("told"))


def guard_pii(spark, d):
    """The first kind of personal item a question names by its pattern alone."""
    q = _C("question")
    return _asked(spark, d).select("qid", "question", F.coalesce(F.when(q.rlike(S.EMAIL), "email"), F.when(q.rlike(S.PAN), "pan"), F.when(q.rlike("[0-9]{12}"), "long_digits"), F.lit("none")).alias("kind")).distinct()


def guard_perf_claim(spark, d):
    """Retrieved texts that speak of returns and state a percentage."""
    t = F.lower("text")
    return table(spark, d, "retrieved_chunks").where("retrieved_id is not null and text is not null").distinct().select("retrieved_id", (t.rlike("(^|[^a-z])(returns?|gain|grew|growth|outperform)([^a-z]|$)") & t.rlike("[0-9] ?(%|per cent)")).alias("claim"))


def node_jsonld(spark, d):
    """Questions and answers, written as a JSON-LD page and read back."""
    n = N.records(table(spark, d, "page_nodes")).where("node_type = 'accordion' and trim(label) <> '' and trim(value) <> ''")
    entry = F.struct(_C("label").alias("name"), F.struct(_C("value").alias("text")).alias("acceptedAnswer"))
    pages = n.groupBy("page_id").agg(F.to_json(F.struct(F.lit("FAQPage").alias("@type"), F.collect_list(entry).alias("mainEntity"))).alias("ld"))
    html = pages.select("page_id", F.concat(F.lit('<html><script type="application/ld+json">'), "ld", F.lit("</script><p>x</p></html>")).alias("html"))
    return N.nodes_of_html(html, "page_id", "html").select("page_id", F.explode("nodes").alias("n")).where("n.origin = 'jsonld'").groupBy("page_id").agg(F.count("*").alias("entries"), F.sum(F.length(F.regexp_replace("n.label", r"\s+", ""))).alias("chars"))


QUERIES = {
    "guard_advice": _rule(S.RULES[0][1]),
    "guard_performance": _rule(S.RULES[1][1]),
    "guard_directed": _rule(S.RULES[2][1]),
    "guard_download": _rule(S.RULES[3][1]),
    "guard_scope": _rule(ACTIONS),
    "friendly_value": friendly_value,
    "friendly_fact": friendly_fact,
    "guard_pii": guard_pii,
    "guard_perf_claim": guard_perf_claim,
    "node_jsonld": node_jsonld,
}
ORACLES = {name: f"select distinct qid, question, {_hit('question', S.RULES[i][1])} is not null as hit from {_A}" for i, name in enumerate(("guard_advice", "guard_performance", "guard_directed", "guard_download"))} | {
    "guard_scope": f"select distinct qid, question, {_hit('question', ACTIONS)} is not null as hit from {_A}",
    "friendly_value": "select distinct fact_key, upper(substr(fact_key, 1, 1)) || substr(replace(fact_key, '_', ' '), 2) as label, case when value_kind = 'percent' then '1.5%' else '1.5' end as sample from fact_labels",
    "guard_pii": f"select distinct qid, question, case when regexp_matches(question, '{S.EMAIL}') then 'email' when regexp_matches(question, '{S.PAN}') then 'pan' when regexp_matches(question, '[0-9]{{12}}') then 'long_digits' else 'none' end as kind from {_A}",
    "guard_perf_claim": "select distinct retrieved_id, regexp_matches(lower(text), '(^|[^a-z])(returns?|gain|grew|growth|outperform)([^a-z]|$)') and regexp_matches(lower(text), '[0-9] ?(%|per cent)') as claim from retrieved_chunks where retrieved_id is not null and text is not null",
    "node_jsonld": r"""select page_id, count(*) as entries, cast(sum(length(regexp_replace(label, '\s+', '', 'g'))) as bigint) as chars from (
        select distinct on (page_id, substr(label || ' ' || trim(regexp_replace(value, '\s+', ' ', 'g'), ' '), 1, 160)) page_id, label from (select distinct * from page_nodes) where node_id is not null and page_id is not null and node_type = 'accordion' and trim(label, ' ') <> '' and trim(value, ' ') <> '' order by node_order) group by page_id""",
}
