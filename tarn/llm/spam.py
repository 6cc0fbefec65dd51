"""Keyword-stuffed and link-list pages: lines labelled by a hidden Markov model.

A text is cut into short line segments (lines, sentences, at most SEGMENT words). Each segment is described by the
shares of function words, links, hashtags, separators, numbers and repeated word pairs; a hidden Markov model over
the states prose, record (table rows and the like, which are content), link list, tag list and menu (keyword and
product lists) labels the whole text at once, and a page is flagged by the share of its words that lie outside
prose and records. The model's counts are fitted on a bounded sample of segments that a few strict rules label.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import hash_sample, ship_package

STATES = ("prose", "record", "link list", "tag list", "menu")
#: Words of a segment at most, and tokens back to which a repeated pair of words is looked for.
SEGMENT, REPEAT_WITHIN = 16, 48
#: Documents (by the hash of their ids) whose segments the model is fitted on at most, and characters taken of each for that.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 10_000
#: Share of words outside prose and records beyond which a page is flagged.
FLAG_SHARE = 0.5
#: Word forms a worker remembers.
REMEMBERED = 300_000

# Frequent function words of English, Hindi and romanised Hindi.
FUNCTION_WORDS = frozenset(
    """a an the of to in on at by for from with without within into over under above below between after before during until since while
    when whenever where because although though unless if in case so that this these those it its is are was were be been has have had do
    does did not no nor and or but as than then once only each every any all both other such which who whom whose what how why you your we
    our they their he she his her i my me can could may might must shall should will would there here about against across per also just
    है हैं था थे की का के को में से पर और या यह वह ये वे कि जो तो भी ही नहीं किसी कोई हर ताकि जैसा लिए साथ तक बाद बिना कर करता करते करने देता रखता लेता
    hai hain ka ke ki ko mein se par aur ya yeh woh nahi kya bhi hi tak liye saath bina kar karta karne deta leta rakhta hota wala jo toh""".split()
)

WORD, FUNCTION, LINK, HASHTAG, NUMBER, SEPARATOR, STOP, COMMA, BREAK, TAGS = (1 << i for i in range(10))
_LINK = re.compile(r"https?:|www\.|href|</?a\b|\]\(", re.I)
_NUMBER = re.compile(r"^[₹$(]*[\d][\d,./:%-]*[)%.,;]*$")
_SEPARATOR = re.compile(r"^[|·•»>→/\\*~–—\-]+$|^[|·•»›→]|[|·•»›→;]$")
_STOP = re.compile(r"[.!?।॥][\"'”’)\]]*$")
_TAGS = re.compile(r"^(tags?|keywords?|labels?|topics?|categories|related|hashtags?|टैग)\s*:$", re.I)
_PARTS = re.compile(r"\w+")
_JOINED = regex.compile(r"\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{Lu}+(?!\p{Ll})|\d+")
_STRIP = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")


class Forms(dict):
    """Number of each token form; its class bits and word number lie in two lists."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}
        self.bits: list[int] = []
        self.word: list[int] = []
        self.parts: list[int] = []

    def __missing__(self, token: str) -> int:
        bare = _STRIP.sub("", token).lower()
        bits = 0
        if token == "\n":
            bits = BREAK
        elif _LINK.search(token):
            bits = LINK | WORD
        elif token.startswith("#") and len(token) > 2 and not token[1:].isdigit():
            bits = HASHTAG | WORD
        elif not bare:
            bits = SEPARATOR if _SEPARATOR.search(token) else 0
        else:
            bits = WORD
            if bare in FUNCTION_WORDS:
                bits |= FUNCTION
            if _NUMBER.match(token):
                bits |= NUMBER
            if _SEPARATOR.search(token):
                bits |= SEPARATOR
            if token.endswith(","):
                bits |= COMMA
            if _TAGS.match(token):
                bits |= TAGS
        if bits & WORD and not bits & LINK and _STOP.search(token) and len(bare) > 1:
            bits |= STOP
        at = self[token] = len(self.bits)
        self.bits.append(bits)
        self.parts.append(len(_PARTS.findall(token)) if bits & LINK else max(1, len(_JOINED.findall(token))) if bits & HASHTAG else 1)
        self.word.append(self.words.setdefault(bare, len(self.words)) if bits & WORD else -1)
        return at


_FORMS = Forms()


def tokens(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(document number, class bits, word number, words) of every token of a batch; a link holds several words."""
    global _FORMS
    if len(_FORMS) > REMEMBERED:
        _FORMS = Forms()
    forms = _FORMS
    at: list[int] = []
    sizes = []
    for text in texts:
        before = len(at)
        if text:
            for line in text.splitlines():
                at.extend(map(forms.__getitem__, line.split()))
                at.append(forms["\n"])
        sizes.append(len(at) - before)
    index = np.array(at, np.int64)
    pick = lambda values, kind: np.array(values, kind)[index] if len(index) else np.empty(0, kind)
    return np.repeat(np.arange(len(texts)), sizes), pick(forms.bits, np.int32), pick(forms.word, np.int64), pick(forms.parts, np.int64)


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, words, features) of the segments of a batch; features are bin numbers, one column per FEATURES entry."""
    doc, bits, word, parts_of = tokens(texts)
    keep = (bits & (WORD | SEPARATOR | BREAK)) > 0
    doc, bits, word, parts_of = doc[keep], bits[keep], word[keep], parts_of[keep]
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(BINS)), np.int64)
    ends = (bits & (STOP | BREAK)) > 0
    run = np.r_[0, np.cumsum(ends[:-1] | (doc[1:] != doc[:-1]))]
    first = np.searchsorted(run, run)
    place = np.arange(len(run)) - first
    length = np.searchsorted(run, run, "right") - first
    parts = np.maximum(1, np.round(length / SEGMENT)).astype(np.int64)
    piece = np.minimum(place * parts // np.maximum(length, 1), parts - 1)
    segment = np.r_[0, np.cumsum((run[1:] != run[:-1]) | (piece[1:] != piece[:-1]))]
    n = segment[-1] + 1
    is_word = (bits & WORD) > 0
    # a pair of words seen a little before in the same text
    w = np.flatnonzero(is_word)
    pair = word[w[:-1]] * 2_000_003 + word[w[1:]] if len(w) > 1 else np.empty(0, np.int64)
    order = np.lexsort((np.arange(len(pair)), pair, doc[w[:-1]] if len(pair) else pair))
    again, often = np.zeros(len(bits), bool), np.zeros(len(bits), bool)
    if len(pair):
        d = doc[w[:-1]]
        same = (pair[order][1:] == pair[order][:-1]) & (d[order][1:] == d[order][:-1]) & (order[1:] - order[:-1] <= REPEAT_WITHIN)
        hits = np.r_[order[1:][same], order[:-1][same]]
        again[w[hits]] = True
        thrice = same[1:] & same[:-1]
        often[w[np.r_[order[2:][thrice], order[1:-1][thrice], order[:-2][thrice]]]] = True
    count = lambda mask: np.bincount(segment, mask, n)
    words = count(is_word)
    total = np.maximum(words, 1)
    share = [count((bits & c) > 0) / total for c in (FUNCTION, LINK, HASHTAG, SEPARATOR, COMMA, NUMBER)] + [count(again & is_word) / total, count(often & is_word) / total, count((bits & TAGS) > 0)]
    run_words = np.bincount(run, is_word)
    stopped = np.bincount(run, (bits & STOP) > 0) > 0
    kind = np.where(stopped & (run_words >= 4) & (run_words <= 70), 2, np.where(stopped, 1, 0))
    share += [kind[run[np.searchsorted(segment, np.arange(n))]], run_words[run[np.searchsorted(segment, np.arange(n))]]]
    columns = [np.digitize(s, edges) for s, edges in zip(share, BINS.values())]
    where = np.flatnonzero(words > 0)
    return doc[np.searchsorted(segment, where)], np.bincount(segment, is_word * parts_of, n)[where].astype(np.int64), np.stack(columns, 1)[where]


#: Bin edges of the features of a segment.
BINS = {
    "function": (0.001, 0.08, 0.17, 0.28),
    "link": (0.001, 0.09, 0.3),
    "hashtag": (0.001, 0.3),
    "separator": (0.001, 0.12, 0.3),
    "comma": (0.001, 0.12, 0.25),
    "number": (0.001, 0.12, 0.3),
    "repeat": (0.001, 0.2, 0.45, 0.7),
    "often": (0.001, 0.3),
    "tags": (0.5,),
    "sentence": (0.5, 1.5),
    "run": (3.5, 8.5, 30.5, 70.5),
}


def strict(features: np.ndarray) -> np.ndarray:
    """A state for the segments that a strict rule tells, -1 for the others."""
    fn, link, tag, sep, comma, number, again, often, caption, sentence, run = features.T
    bare = (link == 0) & (tag == 0) & (caption == 0)
    state = np.full(len(features), -1)
    state[(fn >= 3) & bare & (again <= 1) & (sep <= 1)] = 0
    state[(fn >= 1) & bare & (sentence == 2) & (sep <= 1) & ((often <= 1) | (run >= 2))] = 0
    state[(fn <= 1) & (number >= 2) & (sep >= 1) & bare & (again <= 1) & (run <= 1)] = 1
    state[(link >= 2) & (fn <= 2)] = 2
    state[((tag >= 2) | (caption == 1) | ((comma >= 3) & (again <= 1))) & (fn <= 1) & (link == 0) & (sentence < 2)] = 3
    state[(fn <= 1) & bare & (sentence < 2) & (comma <= 2) & ((again >= 3) | ((sep >= 2) & (number <= 1)))] = 4
    state[(again >= 4) & (link == 0) & (sentence < 2)] = 4
    # short sentences that say the same words over and over
    state[bare & (again >= 3) & (often == 2) & (sentence == 2) & (run <= 1)] = 4
    return state


def fit(texts: list[str]) -> dict:
    """Log probabilities of the model from the strictly labelled segments of a sample; counts start from a prior."""
    doc, words, features = segments(texts)
    state = strict(features)
    known = state >= 0
    emit = []
    for c, edges in enumerate(BINS.values()):
        table = np.full((len(STATES), len(edges) + 1), 1.0)
        np.add.at(table, (state[known], features[known, c]), 1.0)
        emit.append(np.log(table / table.sum(1, keepdims=True)))
    pairs = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
    move = np.full((len(STATES), len(STATES)), 2.0) + 20 * np.eye(len(STATES))
    np.add.at(move, (state[:-1][pairs], state[1:][pairs]), 1.0)
    move = np.log(move / move.sum(1, keepdims=True))
    begin = np.log(np.array([0.6, 0.05, 0.1, 0.1, 0.15]))
    return {"emit": emit, "move": move, "begin": begin}


def label(doc: np.ndarray, features: np.ndarray, model: dict) -> np.ndarray:
    """The most likely state of every segment: Viterbi over the segments of each text, all texts of a batch at once."""
    if not len(doc):
        return np.empty(0, np.int64)
    score = sum(t.T[features[:, c]] for c, t in enumerate(model["emit"]))
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[first, len(doc)])
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    back = np.zeros((len(doc), len(STATES)), np.int8)
    best = model["begin"] + score[first]
    last = best.copy()
    for step in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -step, "left"))
        rows = first[:live] + step
        through = best[:live, :, None] + model["move"]
        back[rows] = through.argmax(1)
        best = through.max(1) + score[rows]
        last[:live] = best
    out = np.zeros(len(doc), np.int64)
    out[first + length - 1] = last.argmax(1)
    for step in range(int(length[0]) - 1, 0, -1):
        live = int(np.searchsorted(-length, -step, "left"))
        rows = first[:live] + step
        out[rows - 1] = back[rows, out[rows]]
    return out


def shares(texts: list[str], model: dict) -> np.ndarray:
    """The share of each text's words that lie in link lists, tag lists and menus."""
    doc, words, features = segments(texts)
    state = label(doc, features, model)
    total = np.bincount(doc, words, len(texts))
    return np.bincount(doc, words * (state >= 2), len(texts)) / np.maximum(total, 1)


def page_shares(documents: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, nonprose_share) of every document.

    Null, empty and blank texts have share 0. Whole texts are read, however long. Rows with a null id stay, repeated
    rows give repeated rows; extra columns are not read. The model is fitted on at most SAMPLE_DOCS texts, chosen by hash of the id.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col(ident).alias("_id"), F.col(text).alias("_text"))
    sample = [r[0] for r in hash_sample(rows.where("_text is not null"), "_id", rows=SAMPLE_DOCS).select(F.substring("_text", 1, SAMPLE_CHARS)).collect()]
    model = documents.sparkSession.sparkContext.broadcast(fit(sample or [""]))

    def run(batches, model=model):
        from tarn.llm.spam import shares

        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                share = shares(part.column("_text").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(share)], ["_id", "nonprose_share"])

    kind = documents.schema[ident].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, nonprose_share double").withColumnRenamed("_id", ident)


def spam_pages(documents: DataFrame, *, ident: str = "doc_id", text: str = "text", share: float = FLAG_SHARE) -> DataFrame:
    """The ids of the documents most of whose words lie in link lists, tag lists and menus; each id once."""
    return page_shares(documents, ident=ident, text=text).where(F.col(ident).isNotNull() & (F.col("nonprose_share") > share)).select(ident).distinct()
