import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import scan as S


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_unicode_blanks_and_hashes(spark):
    text = "a  b \n c　"
    assert one(spark, text, X.squash) == "a b c"
    assert one(spark, text, X.content_hash) == hashlib.sha256(b"a b c").hexdigest()
    assert one(spark, None, X.squash) is None and one(spark, "", X.size_tokens) == 1


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=60))
def test_size_is_the_count_of_the_rule(spark, text):
    text = text.encode("utf-8", "ignore").decode()
    assert one(spark, text, X.size_tokens) == max(1, int(1.3 * len(re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", text))))


def test_questions_and_terms(spark):
    assert one(spark, "What is the NAV of X_Fund at 1.03%?", X.normalised_question) == "nav of x fund at 1.03%"
    assert one(spark, "Tell me the direct growth plan", X.content_terms) == ["direct", "growth", "plan"]
    assert one(spark, "What is the exit load?", X.content_terms) == ["exit", "load"]


def test_sentences(spark):
    assert len(one(spark, "It costs Rs. 1.5 p.m. See https://a.b/c. Mr. X asks! Done", X.sentences)) >= 3
    assert one(spark, "One. Two. Three. Four.", lambda t: X.clip_sentences(t, 2)) == "One. Two."
    assert one(spark, "  ", X.sentences) == []


def test_small_forms(spark):
    assert one(spark, "  exit load - ", X.quote) == "Exit load."
    assert one(spark, "abc", X.mask) == "***" and one(spark, "abcdef", X.mask) == "ab****"
    assert one(spark, "exit load exit load of 1%", X.collapse_repeats) == "exit load of 1%"
    assert one(spark, "NAV: 10.5", X.label_half) == "NAV" and one(spark, "NAV: 10.5", X.value_half) == "10.5"
    assert one(spark, "!!", X.slug) == "unknown" and one(spark, "Oak-Like Fund", X.slug) == "oak_like_fund"
    assert one(spark, "₹1,13,606.47 of 5", X.numbers) == ["113606.47", "5"]


PROBES = [("mail me at a.b@c.co", "email"), ("PAN ABCDE1234F", "pan"), ("call 9876543210", "phone"), ("aadhaar 2345 6789 0123", "aadhaar"), ("account number is 1234567890123456", "account_no"), ("otp is 482913", "otp"), ("IFSC OAKB0001234", "ifsc"), ("dp id 12345678", "demat"), ("code 4829", "possible_otp")]


def test_scan_is_aware_of_overlaps(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PROBES)] + [(90, None), (91, ""), (92, "NAV 1,13,606.47 at 1.03%")], "id int, t string")
    got = {r.id: r for r in S.scanned(rows, "t").withColumn("clean", S.scrubbed(F.col("t"), F.col("matches"))).withColumn("report", S.report(F.col("matches"))).collect()}
    for i, (_, kind) in enumerate(PROBES):
        assert got[i].matches[0].kind == kind, PROBES[i]
    assert got[90].matches == [] and got[92].report == "clean"
    assert got[0].clean == "mail me at [REDACTED]" and got[8].clean == "code 4829"
    for r in got.values():
        spans = sorted((m.start, m.stop) for m in r.matches)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_rules_in_order(spark):
    kinds = {q: one(spark, q, S.first_rule) for q in ("Should I buy?", "Will X beat Y?", "show my portfolio", "download form", "What is the NAV?", "Shouldice instalments")}
    assert list(kinds.values()) == ["advice", "forecast", "personal", "download", "open", "open"]
