import numpy as np
import pytest

from tarn.llm import pii


#: Carriers that are no training carriers; {} stands for the item.
HELD_OUT = {
    "person": ["Sent by {} from home.", "Our cousin {} paid.", "Greetings, {}", "The teacher, Mr. {}, agreed.", "I work with {} now.", "please wake {} early.", "You spoke to {} there."],
    "phone": ["buzz me on {} tonight.", "my new cell is {},", "desk line {};", "send a text to {} -"],
    "email": ["forward it to {} today.", "reach my inbox {},", "mailbox: {};", "subscribe {} please."],
    "id_number": ["tax card {};", "my passport, {}, was stolen.", "permit no {} is old.", "Aadhaar: {}"],
    "address": ["Our flat is {}.", "bring the keys to {}.", "my office is at {},", "parcel for {};"],
}
FILLER = ["The lamp in the hall is broken.", "We saw {n} birds on {n} May.", "Bill {n}44-{n}81-7 is open.", "It rained in Zovupur all day.", "Is Kalemoor Bond Fund open?", "He paid 1,250 for the chair.", "Nobody answers."]


def held_out(count, seed):
    m = pii.Maker(seed)
    for _ in range(count):
        text, spans = "", []
        for _ in range(m.r.randint(1, 4)):
            if m.r.random() < 0.5:
                text += m.r.choice(FILLER).replace("{n}", str(m.r.randint(1, 29)))
            else:
                kind = m.r.choice(sorted(HELD_OUT))
                before, after = m.r.choice(HELD_OUT[kind]).split("{}")
                item = getattr(m, kind)()
                spans.append((len(text + before), len(text + before + item), kind))
                text += before + item + after
            text += " "
        yield text, spans


def field():
    return pii.Field(pii.trained(), pii.vocabulary())


def accuracy(data):
    hit = miss = extra = 0
    for (_, spans), got in zip(data, field().find([t for t, _ in data])):
        hit += len(set(spans) & set(got))
        miss += len(set(spans) - set(got))
        extra += len(set(got) - set(spans))
    return hit / (hit + miss), hit / (hit + extra)


def test_held_out_accuracy():
    recall, precision = accuracy(list(held_out(400, 99)))
    assert recall > 0.9 and precision > 0.9, (recall, precision)
    recall, precision = accuracy(pii.invented(300, 1234))
    assert recall > 0.93 and precision > 0.93, (recall, precision)
    assert not any(c.replace("{}", "") in x for xs in HELD_OUT.values() for c in xs for x in (pii._TO_NAME, *pii._TO_ITEM.values()))


def test_the_field_labels_what_no_pattern_proposes():
    for text, want in (("Please ring 9876-54-32-10 tonight.", "9876-54-32-10"), ("my mobile is +44 20 794 60 95 now", "+44 20 794 60 95")):
        assert pii.proposals(text) == []
        (got,) = field().find([text])
        assert [(k, text[a:b]) for a, b, k in got] == [("phone", want)]
    ticket = "Reference 6712345678 is noted on the bill."
    assert pii.proposals(ticket) and field().find([ticket]) == [[]]


CASES = [
    ("Regards, Moshu B. Logobhore. ok", [("person", "Moshu B. Logobhore")]),
    ("Mr. olbri velvelvani asked me this:", [("person", "olbri velvelvani")]),
    ("OTP did not come to +91 (9278) 241-248. x", [("phone", "+91 (9278) 241-248")]),
    ("Write to vi.jug@net.orbandi.test. Then PAN:ZFPGV9516M;", [("email", "vi.jug@net.orbandi.test"), ("id_number", "ZFPGV9516M")]),
    ("Aadhaar 6674-0433-4108 is linked.", [("id_number", "6674-0433-4108")]),
    ("I live at Flat No. 162, Old Mill Lane, Gulmohra 568 173. ok", [("address", "Flat No. 162, Old Mill Lane, Gulmohra 568 173")]),
    ("The quote 98765.43210 looks odd. Ticket 154-125-6 is open. I hold 1,23,45,678 units.", []),
    ("Circular ABC/DF/138/2022 applies. ISIN INX17K01188. Read @Tidewick handle notes.", []),
]


def test_cases():
    field = pii.Field(pii.trained(), pii.vocabulary())
    for text, want in CASES:
        (got,) = field.find([text])
        assert [(k, text[a:b]) for a, b, k in got] == want, text


def test_repeated_names_help_each_other(monkeypatch):
    text = "My name is Tavelo Morinand and the list shows Tavelo Morinand twice."
    names = lambda: [text[a:b] for a, b, _ in field().find([text])[0]]
    assert names() == ["Tavelo Morinand"] * 2
    monkeypatch.setattr(pii, "SKIP_WEIGHT", 0)
    assert names() == ["Tavelo Morinand"]


def test_a_text_is_read_alike_in_every_batch():
    data = [t for t, _ in held_out(60, 5)]
    alone = [field().find([t])[0] for t in data]
    assert field().find(data) == alone and field().find(data[::-1]) == alone[::-1]


def test_settled_spans_have_the_form_of_their_kind():
    assert pii.plausible("9876-54-32-10", "phone") and not pii.plausible("12,345,678", "phone") and not pii.plausible("250.77/267.77", "phone")
    assert pii.plausible("AB12345678", "id_number") and not pii.plausible("INR 100000", "id_number")
    text = "Regards, Kalemoor Zovar Fund."
    tokens, starts, ends = pii.tokenised(text)
    states = np.array([0, 0, 1, 2, 0, 0])
    assert len(tokens) == 6 and pii.settled(text, tokens, starts, ends, states) == []


def test_tables(spark):
    filler = [(i, "the clerk checks the form at the desk", "z") for i in range(10, 30)]
    rows = [(1, CASES[2][0], "x"), (2, None, "y"), (3, "", None), (4, " ", "v"), (5, "long text here. " * 5_000 + CASES[4][0], "w"), (1, CASES[2][0], "x"), *filler]
    df = spark.createDataFrame(rows, "id int, t string, kind string")
    got = {r.id: r for r in pii.masked(df, "t").collect()}
    assert got[1].masked == "OTP did not come to [PHONE]. x" and got[2].masked is None and got[3].masked == "" and got[4].masked == " "
    assert got[5].masked.endswith("Aadhaar [ID_NUMBER] is linked.") and len(got[5].masked) > 70_000
    with pytest.raises(ValueError):
        pii.with_spans(df, "t", out="kind")
    assert pii.with_spans(df.limit(0), "t").count() == 0


def test_found_has_each_item_once(spark):
    g = spark.createDataFrame([("G1", CASES[2][0]), ("G1", CASES[2][0]), (None, "x"), ("G2", None)], "qid string, question string")
    node = "array<struct<node_order:int,text:string>>"
    c = spark.createDataFrame([(7, [(3, CASES[4][0]), (4, None)]), (7, [(3, CASES[4][0]), (4, None)]), (8, None)], f"page_id long, nodes {node}")
    got = sorted((r.src, r.rec_id, r.node_order, r.kind, r.char_start, r.char_end) for r in pii.found(g, c).collect())
    assert got == [("corpus_docs", "7", 3, "id_number", 8, 22), ("golden_set", "G1", 0, "phone", 20, 38)]
