"""Evaluation passages that leaked into documents.

The normalised word n-grams of all passages form one sorted hash set that is broadcast (its size is checked).
Workers slide a window over the words of each document, look every window up, and verify the hits by chaining them:
a run is a stretch of words that the document and the passage have in common but for small changes. Long enough runs
count as copied text, wherever and in whatever order they stand.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import checkpointed, ship_package

#: Words of a window.
GRAM = 5
#: Words of a run at least: the shortest passage that counts as copied, about a short sentence.
RUN = 8
#: Words between two hits of a run at most, and by how many words the gaps on both sides may differ.
GAP, SHIFT = 7, 3
#: Share of a passage's words that must be copied, and share that must be copied beyond sentences many documents share.
COPIED, OWN = 0.5, 0.25
#: A sentence of a passage is shared if this share of all documents, and at least SHARED_LEAST of them, has it without
#: the rest (less than ALONE of the words beside it).
SHARED, SHARED_LEAST, ALONE = 0.01, 10, 0.2
#: A document with this share of a passage, in several sentences, has the whole passage.
WHOLE = 0.9
#: Share of a sentence's words that must be copied for the sentence to count as copied.
SENTENCE_COPIED = 0.6
#: Words of the passages whose windows one broadcast set may hold; more passages are worked in blocks.
SET_LIMIT = 5_000_000

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n[>\s|]*(?=[^\W\d_])")
_SILENT = re.compile("[̀-ͯ­​-‍⁠﻿'’‘]+")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?।])\s+")


def words(text: str) -> list[str]:
    """Lower-case words without accents, apostrophes and line-end hyphens."""
    if "-" in text or not text.isascii():
        text = _HYPHEN.sub("", text)
    text = _SILENT.sub("", text if text.isascii() else unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


class Passages:
    """The passages' windows as sorted hashes, with the passage and place of each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.length, self.starts = [], [], []
        self.vocabulary: dict[str, int] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        hashes, item, place = [], [], []
        for ident, text in items:
            own = [words(s) for s in _SENTENCE.split(text)]
            flat = [w for s in own for w in s]
            if not flat:
                continue
            k = len(self.ids)
            self.ids.append(ident)
            self.length.append(len(flat))
            self.starts.append([0, *accumulate(len(s) for s in own if s)])
            number = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in flat], np.uint64)
            if len(flat) < GRAM:  # shorter than a window: looked for as a whole
                self.short.setdefault(len(flat), {}).setdefault(int(window_hashes(number, len(flat))[0]), []).append(k)
                continue
            h = window_hashes(number)
            hashes.append(h)
            item.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        empty = np.empty(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.item = (np.concatenate(item) if item else empty)[order]
        self.place = (np.concatenate(place) if place else empty)[order]


def window_hashes(number: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hashes of all windows of `width` numbers."""
    n = len(number) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (number[i : i + n] * np.uint64(0xBF58476D1CE4E5B9))
        h ^= h >> np.uint64(29)
    return h


def chains(segments: list[tuple[int, int, int]], least: int = RUN) -> list[tuple[int, int]]:
    """Passage intervals of the runs of `least` words made of (document place, passage place, words), joined over small changes."""
    runs: list[list[int]] = []
    for q, p, n in sorted(segments):
        for run in reversed(runs):
            dq, dp = q - run[2], p - run[1]
            if -GRAM < dp <= GAP and -GRAM < dq <= GAP and abs(dq - dp) <= SHIFT:
                run[1], run[2] = max(run[1], p + n), max(run[2], q + n)
                break
        else:
            runs.append([p, p + n, q + n])
    return [(a, b) for a, b, _ in runs if b - a >= least]


def leaks(texts: list[str], passages: Passages) -> Iterator[tuple[int, int, float, list[int], bool]]:
    """(document number, passage number, share of the passage copied, its copied sentences, several in one run)."""
    get = passages.vocabulary.get
    numbers: list[int] = []
    sizes = []
    for text in texts:
        found = [get(w, 0) for w in words(text)] if text else []
        numbers += found
        numbers += (0,) * GRAM
        sizes.append(len(found) + GRAM)
    number = np.array(numbers, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    for width, known_short in passages.short.items():
        h = window_hashes(number, width)
        for at in np.flatnonzero(np.isin(h, np.array(list(known_short), np.uint64))).tolist():
            for k in known_short[int(h[at])]:
                yield int(owner[at]), k, 1.0, list(range(len(passages.starts[k]) - 1)), False
    h = window_hashes(number)
    lo = np.searchsorted(passages.hashes, h, "left")
    known = lo < len(passages.hashes)
    known[known] = passages.hashes[lo[known]] == h[known]
    at = np.flatnonzero(known)
    if not len(at):
        return
    lo = lo[at]
    many = np.searchsorted(passages.hashes, h[at], "right") - lo
    q = np.repeat(at, many)
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    doc = owner[q]
    item, p = passages.item[entry], passages.place[entry]
    order = np.lexsort((p, q - p, item, doc))
    doc, item, p, q = doc[order], item[order], p[order], q[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((q - p)[1:] != (q - p)[:-1]) | (p[1:] - p[:-1] > GAP)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1
    n = p[last] - p[first] + GRAM
    doc, item, p, q = doc[first], item[first], p[first], q[first]
    pair = np.r_[0, np.cumsum((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))]
    lengths = np.array(passages.length)
    enough = (np.bincount(pair, n) >= np.minimum(RUN, lengths[item[np.searchsorted(pair, np.arange(pair[-1] + 1))]]))[pair]
    begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    for a, b in zip(begin, np.r_[begin[1:], len(pair)]):
        if not enough[a]:
            continue
        k = int(item[a])
        runs = chains(list(zip(q[a:b].tolist(), p[a:b].tolist(), n[a:b].tolist())), min(RUN, passages.length[k]))
        if runs:
            yield int(doc[a]), k, *copied_part(runs, passages.starts[k])


def copied_part(runs: list[tuple[int, int]], starts: list[int]) -> tuple[float, list[int], bool]:
    """(share of the passage that the runs cover, its copied sentences, several of them in one run)."""
    merged: list[list[int]] = []
    for x, y in sorted(runs):
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
        else:
            merged.append([x, y])
    full, together = [], False
    for s in range(len(starts) - 1):
        begin, stop = starts[s], starts[s + 1]
        if sum(max(0, min(y, stop) - max(x, begin)) for x, y in merged) > SENTENCE_COPIED * (stop - begin):
            full.append(s)
    if len(full) > 1:
        together = any(sum(min(y, starts[s + 1]) - max(x, starts[s]) > SENTENCE_COPIED * (starts[s + 1] - starts[s]) for s in full) > 1 for x, y in runs)
    return sum(y - x for x, y in merged) / starts[-1], full, together


def copied_shares(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, copied, sentences, sentence_words, item_words, together) of every document with a run of a passage.

    The passages are counted before any of them is sent; beyond SET_LIMIT words they are worked in blocks by the hash of
    their ids, each against all documents.
    """
    ship_package(documents.sparkSession)
    known = items.where("item_id is not null and passage is not null").groupBy("item_id").agg(F.min("passage").alias("passage"))
    size = known.agg(F.sum(F.regexp_count("passage", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    blocks = max(1, -(-int(size) // SET_LIMIT))
    parts = [_against(documents, known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)) for block in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _against(documents: DataFrame, items: DataFrame) -> DataFrame:
    passages = Passages([(r[0], r[1]) for r in items.orderBy("item_id").toLocalIterator()])
    shared = documents.sparkSession.sparkContext.broadcast(passages)

    def run(batches, shared=shared):
        from tarn.llm.leakage import leaks

        passages = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                ids = part.column("doc_id").to_pylist()
                out = [(ids[d], passages.ids[k], c, s, [int(passages.starts[k][x + 1] - passages.starts[k][x]) for x in s], passages.length[k], g) for d, k, c, s, g in leaks(part.column("text").to_pylist(), passages)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "copied", "sentences", "sentence_words", "item_words", "together"])

    return _readable(documents).mapInArrow(run, "doc_id bigint, item_id bigint, copied double, sentences array<int>, sentence_words array<int>, item_words int, together boolean")


def _readable(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents in which at least COPIED of the passage's words stand as copied text.

    Sentences that many documents have without the rest of the passage are no leak by themselves: beyond them at
    least OWN of the words must be copied, unless several sentences stand in one run or the document has the WHOLE
    passage. Passages shorter than a window or a run are looked for as a whole. Null and empty texts and passages give
    no row; repeated rows count once. Whole texts are read; extra columns are not.
    """
    pairs = checkpointed(copied_shares(documents, items))
    many = max(SHARED_LEAST, SHARED * _readable(documents).count())
    each = pairs.select("item_id", "copied", "item_words", F.explode(F.arrays_zip("sentences", "sentence_words")).alias("s"))
    rest = F.col("copied") - F.col("s.sentence_words") / F.col("item_words")
    alone = each.where(rest < ALONE).groupBy("item_id", F.col("s.sentences").alias("s")).agg(F.count("*").alias("n")).where(F.col("n") >= many)
    common = alone.groupBy("item_id").agg(F.collect_set("s").alias("common"))
    cases = pairs.where(F.col("copied") >= COPIED).join(common, "item_id", "left")
    borrowed = F.aggregate(F.zip_with("sentences", "sentence_words", lambda s, n: F.when(F.array_contains("common", s), n).otherwise(0)), F.lit(0), lambda a, b: a + b)
    own = F.col("copied") - F.when(F.col("common").isNull(), 0.0).otherwise(borrowed / F.col("item_words"))
    whole = (F.col("copied") >= WHOLE) & (F.size("sentences") > 1)
    return cases.where((own >= OWN) | F.col("together") | whole).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those in which a passage leaked."""
    return documents.join(leaked(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
