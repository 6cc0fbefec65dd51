"""Queries of the attribute-value operator."""

from __future__ import annotations

from tarn.operators import eav
from tarn.session import table


def p1_found(spark, d):
    """The filled cells of the wide table, one row each."""
    long = eav.facts_long(table(spark, d, "page_nodes"), table(spark, d, "fact_labels"))
    return long.where("readable").select("page_id", "fact_key", "typed_value")


def p1_wide(spark, d):
    """One row per page with a typed column per fact and the values that could not be read."""
    labels = table(spark, d, "fact_labels")
    return eav.facts_wide(eav.facts_long(table(spark, d, "page_nodes"), labels), eav.attributes_of(labels))


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide}
ORACLES: dict[str, str] = {}
