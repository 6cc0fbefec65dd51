from tarn.operators import eav

DICTIONARY = [("Expense Ratio", "expense_ratio", "percent"), ("TER", "expense_ratio", "percent"), ("Fund size", "aum", "crore"), ("NAV", "nav", "price"), ("Minimum investment", "minimum_investment", "rupees"), ("Lock-in", "lock_in", "months"), ("Launch date", "launch", "day"), ("Star rating", "rating", "stars"), ("Benchmark index", "benchmark", "words")]
NODES = "page_id long, node_order int, label string, value string, _key string, attr_key string, _known string"


def facts(spark, rows, dictionary=DICTIONARY):
    d = spark.createDataFrame(dictionary, "label_text string, fact_key string, value_kind string")
    n = spark.createDataFrame([(p, o, la, v, "x", "y", "z") for p, o, la, v in rows], NODES)
    return {(r.page_id, r.fact_key): r for r in eav.facts_long(n, d).collect()}


GOOD = ["Expense Ratio", " EXPENSE  RATIO :", "• Expense Ratio", "Expense_Ratio", "Expense Ratio (as on 3 May 2021)", "Expense Ratio ⓘ", "» Expense Ratio*", "Expense Ratio ¹", "Expnse Ratio", "Exepnse Ratio", "Expensse Ratio", "Expanse Ratio", "TER -", "Expense Ratio&nbsp;:"]
OTHER = ["Category expense ratio", "Expense Ratio history", "Rating agency", "NAV on launch", "TXR", None, "", "   ", "Benchmark return", "x" * 500]
VALUES = [
    ("TER", "(0.59%)", "0.59"), ("TER", "1.40 percent p.a.", "1.40"), ("TER", "NIL", "0.00"), ("TER", "2", "2.00"), ("TER", "Refer to SID", None), ("TER", "", None), ("TER", None, None),
    ("NAV", "₹ 134.336 (10 May 2023)", "134.34"), ("NAV", "Rs. 1,627.69", "1627.69"), ("NAV", "2,812.53 per unit", "2812.53"),
    ("Fund size", "₹28,57,033 lakhs", "28570.33"), ("Fund size", "INR 36518.52 cr", "36518.52"), ("Fund size", "—", None),
    ("Minimum investment", "₹2.5 lakh", "250000"), ("Minimum investment", "₹125k", "125000"), ("Minimum investment", "₹500 and in multiples of ₹1", "500"), ("Minimum investment", "Rs.1,500.00", "1500"), ("Minimum investment", "Rs 1 Lac", "100000"),
    ("Lock-in", "3 year(s)", "36"), ("Lock-in", "18 mths", "18"), ("Lock-in", "5Y", "60"), ("Lock-in", "6M", "6"), ("Lock-in", "No lock-in", "0"), ("Lock-in", "5 Years from allotment", "60"),
    ("Launch date", "13th September, 2019", "2019-09-13"), ("Launch date", "01-OCT-14", "2014-10-01"), ("Launch date", "06-DEC-99", "1999-12-06"), ("Launch date", "05/08/2012", "2012-08-05"), ("Launch date", "August 5, 2012", "2012-08-05"), ("Launch date", "24.11.2015", "2015-11-24"), ("Launch date", "2009-04-25", "2009-04-25"), ("Launch date", "31/02/2012", None), ("Launch date", "1 May 1890", None),
    ("Star rating", "★★★☆☆", "3"), ("Star rating", "4 out of 5", "4"), ("Star rating", "2/5", "2"), ("Star rating", "n/a", None),
    ("Benchmark index", "Merid\nMidcap  150 TRI ", "merid midcap 150 tri"),
]


def test_labels_however_printed(spark):
    got = facts(spark, [(i, 0, label, "1.5%") for i, label in enumerate(GOOD)])
    assert [GOOD[i] for i in range(len(GOOD)) if (i, "expense_ratio") not in got] == []
    assert {r.typed_value for r in got.values()} == {"1.50"}


def test_other_labels_are_other_facts(spark):
    assert not facts(spark, [(i, 0, label, "1.5%") for i, label in enumerate(OTHER)])


def test_values_by_kind(spark):
    got = {p: (r.typed_value, r.readable) for (p, _), r in facts(spark, [(i, 0, label, value) for i, (label, value, _) in enumerate(VALUES)]).items()}
    assert [(VALUES[i], got.get(i)) for i in range(len(VALUES)) if got.get(i) != (VALUES[i][2], VALUES[i][2] is not None)] == []


def test_last_readable_value_wins_and_copies_count_once(spark):
    rows = [(1, 0, "TER", "1.0%"), (1, 5, "Expense ratio", "2.0%"), (1, 9, "TER", "coming soon"), (1, 5, "Expense ratio", "2.0%"), (None, 1, "TER", "9%"), (2, None, "TER", "3%"), (2, None, "TER", "4%")]
    got = facts(spark, rows)
    assert got[1, "expense_ratio"].typed_value == "2.00" and got[2, "expense_ratio"].typed_value == "4.00" and len(got) == 2


def test_empty_tables(spark):
    assert facts(spark, []) == {}
    d = spark.createDataFrame([], "label_text string, fact_key string, value_kind string")
    n = spark.createDataFrame([(1, 0, "TER", "1")], "page_id long, node_order int, label string, value string")
    assert eav.facts_long(n, d).count() == 0


def test_wide_keeps_cast_failures(spark):
    d = spark.createDataFrame(DICTIONARY, "label_text string, fact_key string, value_kind string")
    n = spark.createDataFrame([(1, 0, "TER", "1.25%"), (1, 1, "NAV", "ask us"), (2, 0, "Launch date", "3 May 2001"), (3, 0, "NAV", "soon")], "page_id long, node_order int, label string, value string")
    rows = {r.page_id: r for r in eav.facts_wide(eav.facts_long(n, d), eav.attributes_of(d)).collect()}
    assert float(rows[1].expense_ratio) == 1.25 and rows[1].nav is None and rows[1].cast_failures == {"nav": "ask us"}
    assert str(rows[2].launch) == "2001-05-03" and rows[3].cast_failures == {"nav": "soon"}


def test_values_beyond_the_range_of_their_type_are_cast_failures(spark):
    d = spark.createDataFrame(DICTIONARY, "label_text string, fact_key string, value_kind string")
    big = {"Minimum investment": "99999999999999999999 rupees", "Lock-in": "99999999999 months", "NAV": "₹ 99999999999999999.5", "Fund size": "99999999999999999 crore", "TER": "99999999999999999%", "Star rating": "99999999999"}
    n = spark.createDataFrame([(1, i, k, v) for i, (k, v) in enumerate(big.items())] + [(2, 1, "Lock-in", "6 months"), (2, 2, "Lock-in", big["Lock-in"])], "page_id long, node_order int, label string, value string")
    long = eav.facts_long(n, d)
    rows = {r.page_id: r for r in eav.facts_wide(long, eav.attributes_of(d)).collect()}
    assert sorted(rows[1].cast_failures.values()) == sorted(big.values())
    assert rows[2].lock_in == 6 and rows[2].cast_failures == {} and long.where("page_id = 1 and readable").count() == 0


def test_long_labels_follow_the_longest_name(spark):
    name = "The " + "very " * 40 + "long name of a fact"
    got = facts(spark, [(1, 0, name, "2%"), (2, 0, name.replace("long", "lomg"), "3%"), (3, 0, name + " of yours", "4%")], [(name, "long_fact", "percent")])
    assert {k[0]: r.typed_value for k, r in got.items()} == {1: "2.00", 2: "3.00"}


def test_one_hot_entity(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(DICTIONARY, "label_text string, fact_key string, value_kind string")
    n = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("page_id"), F.col("id").cast("int").alias("node_order"), F.lit("NAV").alias("label"), F.col("id").cast("string").alias("value"))
    rows = eav.facts_long(n, d)
    assert rows.count() == 20_000 - 6_667
    assert rows.where("page_id = 7").first().typed_value == "19998.00"
