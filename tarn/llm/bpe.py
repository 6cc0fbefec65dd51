"""Byte-level BPE encoding of a text column with the ranks of a public tokenizer.

The vocabulary file is read on the driver and broadcast (its size is checked); workers encode Arrow batches.
Words are encoded once per worker and remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import ship_package

#: Where the public vocabulary files lie.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64_000_000
#: Distinct words a worker remembers; beyond it the table starts anew.
REMEMBERED = 400_000
#: Words up to so many bytes are merged by repeated scans of the rank array, longer ones with a heap over the same merges.
SCAN_BYTES = 96

# Fixed value: the word pattern of the public byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = 1 << 60
#: A blank beside other white space of ASCII.
BESIDE = ("  ", *(x for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" for x in (" " + c, c + " ")))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        data = lines.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_by_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a short word: boundaries of its parts and, beside each, the rank of joining the part with the next."""
    bounds = list(range(len(word) + 1))
    joined = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    joined.append(NONE)
    while len(bounds) > 2:
        best = min(joined)
        if best == NONE:
            break
        i = joined.index(best)
        del bounds[i + 1], joined[i]
        last = len(bounds) - 2
        joined[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NONE) if i < last else NONE
        if i:
            joined[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word, in n log n: a heap of joins over a linked list of parts."""
    n = len(word)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Words(dict):
    """Ids by word of the pattern; a word that is missing is encoded and remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        if raw in self.ranks:
            ids = (self.ranks[raw],)
        else:
            ids = tuple((merge_by_scan if len(raw) <= SCAN_BYTES else merge_by_heap)(raw, self.ranks))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(raw) <= SCAN_BYTES:
            self[word] = ids
        return ids


class Pieces(dict):
    """Ids by piece of text between single blanks, the blank before it included.

    Such a piece begins and ends with a character that is no white space, so no word of the pattern crosses its ends.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        super().__init__()
        self.words, self.find = Words(ranks), regex.compile(PATTERN).findall
        self.crossing = regex.compile(r" \s|\s |^\s|\s$").search

    def ids(self, text: str) -> list[int]:
        return [i for word in self.find(text) for i in self.words[word]]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.ids(" " + piece))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= SCAN_BYTES:
            self[piece] = ids
        return ids

    def crosses(self, text: str) -> bool:
        """True if a blank stands beside white space, or white space at an end."""
        if text.isascii():
            return any(x in text for x in BESIDE) or text[0].isspace() or text[-1].isspace()
        return self.crossing(text) is not None

    def encode(self, text: str, into: list[int]) -> None:
        if not text or self.crosses(text):
            into += self.ids(text)
            return
        first, *rest = text.split(" ")
        into += self.ids(first)
        into.extend(chain.from_iterable(map(self.__getitem__, rest)))


_KEPT: dict[str, Pieces] = {}


def encode_batches(batches: Iterator[pa.RecordBatch], ranks, key: str, name: str, out: str) -> Iterator[pa.RecordBatch]:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Pieces(ranks.value)
    encode = _KEPT[key].encode
    for batch in batches:
        at = batch.schema.get_field_index(name)
        lists: list[int] = []
        offsets = [0]
        for text in batch.column(at).to_pylist():
            if text:
                encode(text, lists)
            offsets.append(len(lists))
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists, pa.int32()))
        columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
        names = [x for i, x in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, ids], names=[*names, out])


def encode_column(df: DataFrame, text: str, *, out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the text column replaced by `out`, the list of its token ids; no special tokens.

    Empty and null texts give an empty list. Texts are encoded as they are, whole, however long; the strings of
    special tokens are ordinary text. Repeated rows stay. A column that is already called `out` is an error.
    """
    if out in df.columns:
        raise ValueError(f"the input already has a column {out}")
    spark = df.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    schema = T.StructType([f for f in df.schema.fields if f.name != text] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches, ranks=ranks, key=vocabulary, name=text, out=out):
        from tarn.llm.bpe import encode_batches

        return encode_batches(batches, ranks, key, name, out)

    return df.mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of token ids, for round trips."""
    back = {rank: token for token, rank in load_ranks(vocabulary).items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def document_ids(documents: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every document (query p6_ids)."""
    return encode_column(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "text", vocabulary=vocabulary)
