from tarn.llm import leakage as L

PASSAGE = "The heir returns the revised mandate form over many pages today. The dealing desk corrects the older income schedule during the week. An account statement delays the combined duty note outside of the town. Savers should always read every paper with care before paying."
OTHER = "Nothing of this stands anywhere else in the corpus at all, my friend. It is only here to fill the table with one more passage of words."


def wrapped(text, width=40):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n> ".join([*out, line])


def found(spark, docs, items=((1, PASSAGE), (2, OTHER))):
    d = spark.createDataFrame(list(docs), "doc_id long, text string, copied string")
    i = spark.createDataFrame(list(items), "item_id long, passage string")
    return {(r.doc_id, r.item_id) for r in L.leaked(d, i).collect()}


def test_copies_and_changes(spark):
    sentences = PASSAGE.split(". ")
    docs = [
        (1, "Before. " + PASSAGE + " After.", None), (2, wrapped(PASSAGE), None), (3, PASSAGE.upper().replace(".", " !"), None), (4, ". ".join(reversed(sentences)), None),
        (5, PASSAGE.replace("revised", "revsed").replace("older", "newer").replace("combined", "joint"), None), (6, PASSAGE.replace("statement", "state-\nment").replace("duty", "dúty"), None),
        (7, sentences[0] + ".", None), (8, "The heir and the dealing desk read the duty note. The mandate form is older. Savers pay.", None), (9, None, None), (10, "", None), (1, "Before. " + PASSAGE + " After.", None), (11, "x " * 20_000 + PASSAGE, None),
    ]
    assert found(spark, docs) == {(i, 1) for i in (1, 2, 3, 4, 5, 6, 11)}


def test_shared_sentences_are_no_leak(spark):
    common = "Savers should always read every paper with care before paying any money at all."
    item = "A short own sentence stands here first. " + common
    docs = [(i, f"Text number {i} says little. {common}", None) for i in range(30)] + [(99, item, None)]
    assert found(spark, docs, [(5, item)]) == {(99, 5)}


LONG = "Savers should always read every paper with care before paying any money at all to anyone."


def test_quotations_in_a_small_share_of_documents_are_not_shared_sentences(spark):
    item = LONG + " Then ask twice."
    docs = [(i, f"Text number {i} says little. {LONG}", None) for i in range(25)] + [(i, f"Text number {i} says nothing of it.", None) for i in range(100, 3_100)]
    assert found(spark, docs, [(5, item)]) == {(i, 5) for i in range(25)}


def test_several_sentences_in_one_run_stay_a_leak(spark):
    item = LONG + " Then ask twice more."
    docs = [(i, f"Text number {i} says little. {LONG}", None) for i in range(30)] + [(99, "Before. " + item + " After.", None)]
    assert found(spark, docs, [(5, item)]) == {(99, 5)}


def test_a_whole_passage_stays_a_leak_beside_quotations(spark):
    parts = PASSAGE.split(". ")
    scattered = " Nothing of that kind was ever said here before by any of us. ".join(p.rstrip(".") + "." for p in reversed(parts))
    docs = [(i, f"Text number {i} says little. {parts[i % 4].rstrip('.')}.", None) for i in range(80)] + [(99, scattered, None), (98, "Before. " + PASSAGE, None)]
    assert found(spark, docs, [(1, PASSAGE)]) == {(98, 1), (99, 1)}


def test_short_passages_are_found_as_a_whole(spark):
    docs = [(1, "It is said: Too short! And so on.", None), (2, "too long and short", None), (3, "six words make a small passage", None), (4, "make a small passage", None)]
    assert found(spark, docs, [(1, "too short"), (2, "Six words make a small passage.")]) == {(1, 1), (3, 2)}


def test_blocks_of_passages_change_nothing(spark, monkeypatch):
    docs = [(1, "Before. " + PASSAGE, None), (2, OTHER, None)]
    monkeypatch.setattr(L, "SET_LIMIT", 30)
    assert found(spark, docs) == {(1, 1), (2, 2)}


def test_empty_inputs(spark):
    assert found(spark, [(1, PASSAGE, None)], [(1, None), (2, ""), (3, "too short")]) == set()
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, passage string")
    assert L.leaked(d, i).count() == 0 and L.without_leaks(d, i).count() == 0
