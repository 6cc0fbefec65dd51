"""Cutting oversized texts into overlapping pieces at natural boundaries, by ranges.

A text is worked in ranges. For each range a worker finds the anchor: the strongest boundary near the range's start
(seen through a halo). The anchors form the boundary table, one small row per range; stitched in order they say
where each range's own part begins and ends. Sums over it give the size of the whole text, which decides whether it is
cut at all, and prefix sums number the pieces. Then every range
emits the pieces of its own part by offset. No step needs the whole text: `split_file` reads only byte ranges.

Size in tokens: the whole part of 1.3 times the number of runs of ASCII letters and digits and of other signs that
are no white space; at least 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.session import ship_package

LIMIT, OVERLAP = 400, 50
#: Characters of one range of a text, and of its halo on either side; every text is cut by ranges of this width.
RANGE, HALO = 1 << 13, 1 << 10
#: The same for files, in bytes.
FILE_RANGE, FILE_HALO = 1 << 20, 1 << 13
#: Characters of pieces in one output batch, about.
BATCH_CHARS = 4_000_000
TOKENS_PER_MATCH = 1.3

TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")

HARD, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)


def matches_within(tokens: int) -> int:
    """The most matches whose size is at most so many tokens."""
    n = int((tokens + 1) / TOKENS_PER_MATCH) + 1
    while int(n * TOKENS_PER_MATCH) > tokens:
        n -= 1
    return n


#: Texts from this length on are tokenised by arrays; shorter ones are faster by the pattern.
BY_ARRAYS = 1_500
_SPACES = np.array([chr(c).isspace() for c in range(0x3001)])
_SENTENCE, _CLAUSE, _CLOSING = (np.array([ord(c) for c in chars], np.uint32) for chars in (".!?।॥", ",;:—–", "\"')]”’»"))


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans_by_arrays(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the token matches: what TOKEN matches, by comparing arrays."""
    word = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    sign = ~word
    low = codes < len(_SPACES)
    sign[low] &= ~_SPACES[codes[low]]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    return np.flatnonzero(first | sign), np.flatnonzero(last | sign) + 1


def token_spans(text: str, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the token matches in text[:stop]."""
    if stop < BY_ARRAYS:
        spans = [m.span() for m in TOKEN.finditer(text, 0, stop)]
        both = np.array(spans, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]
    return spans_by_arrays(codes_of(text[:stop]))


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The strength of the gap before each token: by what ends before it and by the line ends in it."""
    strength = np.full(len(starts), HARD, np.int8)
    if len(starts) < 2:
        return strength
    begin = int(starts[0])
    codes = codes_of(text[begin : int(ends[-1])])
    wide = starts[1:] > ends[:-1]
    lines = np.searchsorted(np.flatnonzero(codes == 10) + begin, np.stack([ends[:-1], starts[1:]]))
    lines = lines[1] - lines[0]
    before = codes[ends[:-1] - 1 - begin]
    behind = np.r_[before[:1], before[:-1]]  # what stands before a closing sign
    before = np.where(np.isin(before, _CLOSING) & (np.arange(1, len(starts)) > 1), behind, before)
    inline = np.where(np.isin(before, _SENTENCE), SENTENCE, np.where(np.isin(before, _CLAUSE), CLAUSE, BLANK))
    strength[1:] = np.where(~wide, HARD, np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, inline)))
    return strength


def cut(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as (first, stop) token numbers: each holds at most `limit` matches, the last `overlap` or fewer are repeated."""
    n, first, out, floor = len(strength), 0, [], 0
    while n - first > limit:
        low, high = max(floor + 1, first + limit // 2), first + limit
        window = strength[low : high + 1]
        best = int(window.max())
        if best < SENTENCE:
            wider = strength[floor + 1 : low]
            if len(wider) and wider.max() >= SENTENCE:
                low, window, best = floor + 1, strength[floor + 1 : high + 1], int(wider.max())
        stop = low + int(np.flatnonzero(window == best)[-1])
        out.append((first, stop))
        floor = stop
        begin = max(first + 1, stop - overlap)
        near = np.flatnonzero(strength[begin : begin + overlap // 2 + 1] >= SENTENCE)
        if not len(near):
            near = np.flatnonzero(strength[begin:stop] >= BLANK)
        first = begin + int(near[0]) if len(near) else begin
    out.append((first, n))
    return out


def pieces_of(text: str, begin: int, stop: int, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(char_start, char_end, matches) of the pieces of text[begin:stop]; what lies before begin may be repeated by the first."""
    starts, ends = token_spans(text, stop)
    own = int(np.searchsorted(starts, begin))
    back = max(0, own - overlap) if begin else own
    starts, ends = starts[back:], ends[back:]
    if not len(starts):
        yield begin, stop, 0
        return
    if own == back and len(starts) <= limit:
        yield begin, stop, len(starts)
        return
    strength = boundaries(text, starts, ends)
    if own > back:
        inside = np.flatnonzero(strength[: own - back] >= BLANK)
        skip = int(inside[0]) if len(inside) else 0
        starts, strength = starts[skip:], strength[skip:]
    spans = cut(strength, limit, overlap)
    for k, (a, b) in enumerate(spans):
        yield int(starts[a]) if k or own > back else begin, int(starts[b]) if k < len(spans) - 1 else stop, b - a


def anchor_of(text: str, at: int, halo: int) -> int:
    """The strongest boundary in text[at : at + halo], the first of them; `at` itself if there is none at all."""
    best, where = HARD, at
    previous = None
    for m in TOKEN.finditer(text, max(0, at - 1), min(len(text), at + halo)):
        if previous is not None and m.start() >= at:
            gap = text[previous.end() : m.start()]
            rank = PARAGRAPH if gap.count("\n") > 1 else LINE if "\n" in gap else SENTENCE if gap and previous.group()[-1] in ".!?।॥" else BLANK if gap else HARD
            if rank > best:
                best, where = rank, m.start()
                if rank == PARAGRAPH:
                    break
        previous = m
    return where


def matches_between(text: str, begin: int, stop: int) -> int:
    """The token matches that start in text[begin:stop]; a run that began before counts there."""
    return int((token_spans(text, stop)[0] >= begin).sum())


def _stitch(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """The boundary table with each range's own part: from its anchor to the next range's."""
    ahead = Window.partitionBy(*keys).orderBy("range_no")
    return anchors.withColumn("part_end", F.coalesce(F.lead("anchor").over(ahead), F.col("length"))).where("part_end > anchor or length = 0")


def _numbered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces with piece_no from 0: a prefix sum of the number of pieces of the ranges before."""
    counts = pieces.groupBy(*keys, "range_no").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return pieces.join(before.drop("_n"), [*keys, "range_no"]).withColumn("piece_no", (F.col("_before") + F.col("_local")).cast("int")).drop("_before", "_local", "range_no")


_EMIT = "char_start long, char_end long, n_tokens int, piece string"


def _emit_batches(batches, names, limit, overlap):
    """Pieces of rows that hold the keys, range_no, base (offset of `chunk` in the text), anchor, part_end and chunk."""
    for batch in batches:
        rows = batch.to_pydict()
        fresh = lambda: {k: [] for k in [*names, "range_no", "_local", "char_start", "char_end", "n_tokens", "piece"]}
        kinds = pa.schema([*(batch.schema.field(k) for k in names), ("range_no", pa.int64()), ("_local", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int32()), ("piece", pa.string())])
        out: dict[str, list] = fresh()
        held = 0
        for i in range(batch.num_rows):
            held += len(rows["chunk"][i])
            if held > BATCH_CHARS:
                yield pa.RecordBatch.from_pydict(out, schema=kinds)
                out, held = fresh(), len(rows["chunk"][i])
            chunk, base = rows["chunk"][i], rows["base"][i]
            for local, (a, b, n) in enumerate(pieces_of(chunk, rows["anchor"][i] - base, rows["part_end"][i] - base, limit, overlap)):
                for k in names:
                    out[k].append(rows[k][i])
                for k, v in (("range_no", rows["range_no"][i]), ("_local", local), ("char_start", base + a), ("char_end", base + b), ("n_tokens", max(1, int(n * TOKENS_PER_MATCH))), ("piece", chunk[a:b])):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=kinds)


def split_column(df: DataFrame, keys: list[str], text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, width: int = RANGE, halo: int = HALO) -> DataFrame:
    """(keys, piece_no, char_start, char_end, n_tokens, piece) of every text; keys must name a text.

    Null texts give no piece; empty and blank texts and texts under the limit give one piece, unchanged. Pieces hold
    at most `limit` tokens; each after the first repeats up to `overlap` tokens of the end of the one before. Cuts
    lie at the strongest boundary of the piece's second half (paragraph, line, sentence, clause, blank), at a
    sentence further up if there is none, and inside a word only if nothing else is there. Without the repeated part
    the pieces of a text join to the text. Other columns are dropped; repeated rows with equal keys count once.
    The texts are worked in ranges of `width` characters, of which each has pieces of its own; one range is enough
    for a text of at most `width` characters, so only longer ones are shuffled by ranges.
    """
    ship_package(df.sparkSession)
    base = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text")).dropDuplicates([*keys]).withColumn("length", F.length("_text").cast("long"))
    most, again = matches_within(limit), matches_within(overlap)
    names = list(keys)
    fields = ", ".join(f"`{k}` {base.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, range_no long, _local long, {_EMIT}"

    def emit(batches, names=names, most=most, again=again):
        from tarn.llm.splitting import _emit_batches

        return _emit_batches(batches, names, most, again)

    short = base.where(F.col("length") <= width).select(*keys, F.lit(0).cast("long").alias("range_no"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("anchor"), F.col("length").alias("part_end"), F.col("_text").alias("chunk"))
    def part(n: Column) -> Column:
        start = F.greatest(F.lit(0), n * width - halo)
        return F.struct(n.alias("range_no"), start.alias("base"), F.substring(F.col("_text"), start.cast("int") + 1, F.lit(width + 3 * halo)).alias("chunk"))

    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width)), part)
    ranges = base.where(F.col("length") > width).select(*keys, "length", F.explode(parts).alias("_r")).select(*keys, "length", "_r.*").repartition(*keys, "range_no")

    def anchors(batches, width=width, halo=halo):
        from tarn.llm.splitting import anchor_of, matches_between

        for batch in batches:
            rows = batch.to_pydict()
            found, matches = [], []
            for n, b, c, size in zip(rows["range_no"], rows["base"], rows["chunk"], rows["length"]):
                own = n * width - b
                here = anchor_of(c, own, halo) if n else 0
                ahead = anchor_of(c, own + width, halo) if (n + 1) * width < size else len(c)
                found.append(b + here)
                matches.append(matches_between(c, here, ahead))
            yield batch.append_column("anchor", pa.array(found, pa.int64())).append_column("matches", pa.array(matches, pa.int64())).drop_columns(["chunk", "base"])

    table = ranges.mapInArrow(anchors, f"{fields}, length long, range_no long, anchor long, matches long")
    table = table.withColumn("total", F.sum("matches").over(Window.partitionBy(*keys)))
    cut_up = table.where(F.col("total") > most)
    stitched = _stitch(cut_up, keys).select(*keys, "range_no", "anchor", "part_end")
    out_long = _numbered(ranges.join(stitched, [*keys, "range_no"]).select(*keys, "range_no", "base", "anchor", "part_end", "chunk").mapInArrow(emit, schema), keys)
    few = table.where((F.col("total") <= most) & (F.col("range_no") == 0)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    one_piece = base.where(F.col("length") > width).join(few, same, "left_semi").select(*keys, F.lit(0).cast("long").alias("range_no"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("anchor"), F.col("length").alias("part_end"), F.col("_text").alias("chunk"))
    out_short = short.unionByName(one_piece).mapInArrow(emit, schema).withColumn("piece_no", F.col("_local").cast("int")).drop("_local", "range_no")
    columns = [*keys, "piece_no", "char_start", "char_end", "n_tokens", "piece"]
    return out_short.select(*columns).unionByName(out_long.select(*columns))


def _read_range(path: str, start: int, stop: int) -> tuple[int, str]:
    """The text of a file's bytes from the first whole character at or after start; and that character's offset."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with system.open_input_file(inner) as handle:
        raw = handle.read_at(max(0, min(stop, handle.size()) - start), start)
    lead = 0
    while start and lead < min(4, len(raw)) and raw[lead] & 0xC0 == 0x80:
        lead += 1
    return start + lead, raw[lead:].decode("utf-8", "surrogateescape")


def _byte_length(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def split_files(files: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, width: int = FILE_RANGE, halo: int = FILE_HALO) -> DataFrame:
    """(path, piece_no, byte_start, byte_end, n_tokens, piece) of text files (path, length), however large.

    Tasks read byte ranges with halos; what travels between them is the boundary table, one row per range. Null paths
    and empty files give no piece; repeated rows count once; bytes that are no UTF-8 are kept apart and come out as
    the replacement character.
    """
    ship_package(files.sparkSession)
    known = files.where("path is not null and length > 0").select("path", F.col("length").cast("long").alias("length")).distinct()
    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    ranges = known.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width)))).repartition(tasks, "path", "range_no")

    def anchors(batches, width=width, halo=halo):
        from tarn.llm.splitting import _byte_length, _read_range, anchor_of

        for batch in batches:
            rows, found = batch.to_pydict(), []
            for path, size, n in zip(rows["path"], rows["length"], rows["range_no"]):
                if not n:
                    found.append(0)
                    continue
                base, text = _read_range(path, n * width - halo, min(size, n * width + halo))
                at = len(text.encode("utf-8", "surrogateescape")[: n * width - base].decode("utf-8", "ignore"))
                found.append(base + _byte_length(text[: anchor_of(text, at, halo)]))
            yield batch.append_column("anchor", pa.array(found, pa.int64()))

    table = ranges.mapInArrow(anchors, "path string, length long, range_no long, anchor long")
    stitched = _stitch(table, ["path"]).repartition(tasks, "path", "range_no")
    most, again = matches_within(limit), matches_within(overlap)

    def emit(batches, halo=halo, most=most, again=again):
        from tarn.llm.splitting import TOKENS_PER_MATCH, _byte_length, _read_range, pieces_of

        names = ["path", "range_no", "_local", "byte_start", "byte_end", "n_tokens", "piece"]
        kinds = pa.schema([(x, pa.string() if x in ("path", "piece") else pa.int32() if x == "n_tokens" else pa.int64()) for x in names])
        for batch in batches:
            rows = batch.to_pydict()
            for path, n, anchor, stop in zip(rows["path"], rows["range_no"], rows["anchor"], rows["part_end"]):
                base, text = _read_range(path, max(0, anchor - halo), stop)
                begin = len(text.encode("utf-8", "surrogateescape")[: anchor - base].decode("utf-8", "surrogateescape"))
                out: dict[str, list] = {x: [] for x in names}
                at = size = 0  # bytes up to a character that has been counted
                for k, (a, b, m) in enumerate(pieces_of(text, begin, len(text), most, again)):
                    size += _byte_length(text[at:a]) if a >= at else -_byte_length(text[a:at])
                    at = a
                    for x, v in zip(names, (path, n, k, base + size, base + size + _byte_length(text[a:b]), max(1, int(m * TOKENS_PER_MATCH)), text[a:b].encode("utf-8", "surrogateescape").decode("utf-8", "replace"))):
                        out[x].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    pieces = stitched.mapInArrow(emit, "path string, range_no long, _local long, byte_start long, byte_end long, n_tokens int, piece string")
    return _numbered(pieces, ["path"]).select("path", "piece_no", "byte_start", "byte_end", "n_tokens", "piece")


def split_file(spark: SparkSession, path: str, size: int, *, limit: int = LIMIT, overlap: int = OVERLAP, width: int = FILE_RANGE, halo: int = FILE_HALO) -> DataFrame:
    """The pieces of one file of `size` bytes, as by split_files."""
    return split_files(spark.createDataFrame([(path, size)], "path string, length long"), limit=limit, overlap=overlap, width=width, halo=halo)


def text_files(df: DataFrame, text: str, folder: str) -> DataFrame:
    """(path, length) of text files written to a shared folder, one line for each text; a null text is an empty line."""
    df.select(F.coalesce(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("")).alias("value")).write.mode("overwrite").text(folder)
    return df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")


def items(corpus_docs: DataFrame, retrieved_chunks: DataFrame) -> DataFrame:
    """(src, item_id, text) of the node texts of corpus_docs and the texts of retrieved_chunks."""
    nodes = corpus_docs.select("page_id", F.explode("nodes").alias("n")).select(F.lit("corpus_docs").alias("src"), F.concat(F.col("page_id").cast("string"), F.lit("#"), F.col("n.node_order").cast("string")).alias("item_id"), F.col("n.text").alias("text"))
    chunks = retrieved_chunks.select(F.lit("retrieved_chunks").alias("src"), F.col("retrieved_id").cast("string").alias("item_id"), "text")
    return nodes.unionByName(chunks).where("item_id is not null")


def oversized(texts: DataFrame, keys: list[str], text: str = "text", *, limit: int = LIMIT) -> DataFrame:
    """The distinct keys of the texts of more than `limit` tokens: those that are cut into several pieces."""
    return split_column(texts, keys, text, limit=limit).where("piece_no = 1").select(*keys).distinct()
