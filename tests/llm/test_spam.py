import pytest

from tarn.llm import spam

PROSE = ["The clerk checks the older form before the audit of the fund. ", "A saver may ask for the statement at any time, and the desk sends it within three days. ", "यह योजना हर महीने खाता विवरण ईमेल से भेजता है और शेष राशि नकद में रहती है। ", "yeh scheme nominee free mein add karta hai, bina kisi charge ke. "]
GOOD = {i: p * 12 for i, p in enumerate(PROSE)} | {
    10: PROSE[0] * 6 + "\nTreasury bills | 1.2%\nCement | 3.4%\nBanks | 2.0%\n" + PROSE[1] * 3,
    11: "".join(f"TER: The scheme holds {i} companies at the close of business.\n" for i in range(9)),
    12: PROSE[1] * 8 + "\nSee also:\nhttps://a.example/x\nhttps://b.example/y",
    14: "He waits at the desk. She waits at the door. The desk is old.",
    13: "".join(f"Northbeam Gilt Fund revises the daily note of the week {i} after the audit. " for i in range(20)),
}
BAD = {
    20: "zero commission SIP calculator " * 40,
    21: " ".join(f"#BestFund{i}City" for i in range(40)),
    22: "\n".join(f"[gold fund town{i}](https://x{i}.example/p?id={i})" for i in range(30)),
    23: "\n".join(f"Visit cheap fund - www.site{i}.example/go/{i}" for i in range(30)),
    24: PROSE[0] + "Tags: " + ", ".join(["gold fund", "insurance", "best plan", "ELSS", "top funds", "retirement plan"] * 8),
    25: PROSE[1] + " | ".join(f"Northbeam {x} Fund" for x in ("Gilt", "Liquid", "ELSS", "Index") * 10),
    26: "top best fund SIP plan tax free online India return growth " * 20,
    28: " ".join(f"{v} cheap zuno lamps {p} {t}." for t in ("Abota", "Befira", "Comalo", "Dusira", "Eripo") for v, p in (("Get", "in"), ("Buy", "at"), ("Find", "from"))),
    29: PROSE[1] + PROSE[0] + " ".join(f"#CheapFund{a}{b}Town" for a in ("Gold", "Gilt", "Tax") for b in ("Alba", "Bero", "Cami", "Dora")),
    27: "टॉप फंड सबसे अच्छा फंड एसआईपी प्लान टैक्स बचत " * 30,
}


def test_prose_and_spam(spark):
    rows = list((GOOD | BAD).items()) * 2 + [(90, None), (91, ""), (92, " \n "), (93, PROSE[1] * 4_000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("extra", "extra")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == set(BAD)
    shares = {r.doc_id: r.nonprose_share for r in spam.page_shares(df).collect()}
    assert shares[90] == shares[91] == shares[92] == 0 and len(shares) == len(GOOD) + len(BAD) + 5


def test_empty_table(spark):
    assert spam.spam_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_batches_do_not_matter():
    model = spam.fit([*GOOD.values(), *BAD.values()])
    texts = [*GOOD.values(), *BAD.values()]
    alone = [spam.shares([t], model)[0] for t in texts]
    assert list(spam.shares(texts, model)) == pytest.approx(alone)
