import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import splitting as S


def size(text):
    return max(1, int(len(S.TOKEN.findall(text)) * S.TOKENS_PER_MATCH))


def check(text, pieces, limit=S.LIMIT, overlap=S.OVERLAP):
    """pieces: (start, end, n, piece) in order."""
    end = 0
    for k, (a, b, n, piece) in enumerate(pieces):
        assert piece == text[a:b] and n == size(piece) and (n <= limit or len(pieces) == 1 and size(text) <= limit)
        assert (a == 0) if k == 0 else a <= end
        if k:
            assert len(S.TOKEN.findall(text[a:end])) <= S.matches_within(overlap)
        end = b
    assert end == len(text)


def test_matches_within():
    for tokens in (1, 2, 5, 50, 400, 1000):
        n = S.matches_within(tokens)
        assert int(n * 1.3) <= tokens < int((n + 1) * 1.3)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n,!é-", max_size=900))
def test_pieces_of_one_text(text):
    most, again = S.matches_within(20), S.matches_within(5)
    check(text, [(a, b, max(1, int(n * 1.3)), text[a:b]) for a, b, n in S.pieces_of(text, 0, len(text), most, again)], 20, 5)


def slow_boundaries(text, starts, ends):
    out = [S.HARD]
    for k in range(1, len(starts)):
        gap = text[ends[k - 1] : starts[k]]
        before = text[ends[k - 1] - 1]
        if before in "\"')]”’»" and k > 1:
            before = text[ends[k - 2] - 1]
        out.append(S.HARD if not gap else S.PARAGRAPH if gap.count("\n") > 1 else S.LINE if "\n" in gap else S.SENTENCE if before in ".!?।॥" else S.CLAUSE if before in ",;:—–" else S.BLANK)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1. \n,!é-\"')\x1c\x85\u3000नी\U0001f600\ud800", max_size=300))
def test_arrays_equal_the_pattern(text):
    want = [m.span() for m in S.TOKEN.finditer(text)]
    starts, ends = S.spans_by_arrays(S.codes_of(text))
    assert list(zip(starts.tolist(), ends.tolist())) == want
    assert S.boundaries(text, starts, ends).tolist() == (slow_boundaries(text, starts, ends) if want else [])


TEXTS = {"a": "word " * 2_000, "b": "One two three four. " * 400 + "\n\n" + "Next part here; " * 300, "c": "short", "d": "", "e": "x" * 9_000, "f": ".," * 900, "g": "é　ü " * 800, "h": "   "}


@pytest.mark.parametrize("width, halo", [(S.RANGE, S.HALO), (1_500, 300)])
def test_ranges(spark, width, halo):
    df = spark.createDataFrame([*TEXTS.items(), ("n", None), ("c", "short")], "k string, t string")
    got = {}
    for r in S.split_column(df, ["k"], "t", width=width, halo=halo).collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == set(TEXTS)
    for k, rows in got.items():
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        check(TEXTS[k], [(r.char_start, r.char_end, r.n_tokens, r.piece) for r in rows])


def test_file_by_byte_ranges(spark, tmp_path):
    text = "é One two three. " * 3_000 + "\n\n" + "नमस्ते दुनिया। " * 900
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    raw = path.read_bytes()
    rows = sorted(S.split_file(spark, str(path), len(raw), width=10_000, halo=1_000).collect(), key=lambda r: r.piece_no)
    end = 0
    for r in rows:
        assert raw[r.byte_start : r.byte_end].decode() == r.piece and r.byte_start <= end and size(r.piece) <= S.LIMIT
        end = r.byte_end
    assert end == len(raw) and len(rows) > 10


def test_natural_boundaries():
    text = "First sentence is here. " * 40
    cuts = [b for _, b, _ in S.pieces_of(text, 0, len(text), 50, 10)][:-1]
    assert all(text[:b].rstrip().endswith(".") for b in cuts)


def test_oversized_counts_by_ranges(spark):
    df = spark.createDataFrame([*TEXTS.items(), ("n", None)], "k string, text string")
    big = {k for k, t in TEXTS.items() if size(t) > 400}
    assert {r.k for r in S.oversized(df, ["k"]).collect()} == big
    rows = S.split_column(df, ["k"], "text", width=97, halo=20).collect()
    assert {r.k for r in rows if r.piece_no == 1} == big
    assert {r.k: r.piece for r in rows if r.k not in big} == {k: t for k, t in TEXTS.items() if k not in big}
    assert S.oversized(df.limit(0), ["k"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n,!é-", max_size=400), st.integers(1, 40))
def test_matches_add_up_over_ranges(text, width):
    anchors = [0, *(S.anchor_of(text, at, 7) for at in range(width, len(text), width)), len(text)]
    anchors = [max(anchors[: i + 1]) for i in range(len(anchors))]
    assert sum(S.matches_between(text, a, b) for a, b in zip(anchors, anchors[1:])) == len(S.TOKEN.findall(text))


def test_files_of_a_table(spark, tmp_path):
    texts = [f"Line {i} says: one two three four. " * (i % 9 + 1) for i in range(600)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3)
    files = S.text_files(df, "text", str(tmp_path / "out"))
    got = {}
    for r in S.split_files(files, width=5_000, halo=500).collect():
        got.setdefault(r.path, []).append(r)
    joined = []
    for path, rows in got.items():
        raw, end = open(path.removeprefix("file:"), "rb").read(), 0
        for r in sorted(rows, key=lambda r: r.piece_no):
            assert raw[r.byte_start : r.byte_end].decode() == r.piece and r.byte_start <= end and size(r.piece) <= S.LIMIT
            end = r.byte_end
        assert end == len(raw)
        joined += raw.decode().splitlines()
    assert sorted(joined) == sorted([*texts, ""]) and len(got) == 3
