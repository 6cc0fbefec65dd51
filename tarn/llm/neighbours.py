"""The most similar vectors of every vector by multi-index hashing.

Vectors get binary codes from a learned rotation (principal axes of a bounded sample, rotated so that signs lose
least). A code is split into substrings, each with an index of its own. Two codes within a Hamming radius of
tables * (probe + 1) - 1 agree in at least one substring but for `probe` bits (pigeonhole), so probing each index
with all substrings that differ in so many bits retrieves every such pair. Retrieved pairs are compared by whole
codes, then by their cosine on the components. All vectors are indexed and all are queries. Below the similarities
that the codes retrieve, what the index leaves open is searched exactly.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import checkpoint_dir, checkpointed, dropped, hash_sample, kept, removed, ship_package

DIMENSION = 128
K = 5
#: Rows (by the hash of their ids) to which the rotation is fitted; the bound of what is collected.
SAMPLE_ROWS = 4_096
#: Codes further apart than this are not compared by components: the mean distance at cosine 0.80 plus four deviations.
RADIUS = 44
#: Vectors one task holds; beyond it the tables are split into groups, and groups of twice as many into equal parts.
GROUP_ROWS = 65_536
#: Rows of one file of a split table; a task that writes them holds them twice.
SEGMENT_ROWS = 262_144
#: Pairs whose codes are compared at once.
CANDIDATES = 250_000
#: Entries of one substring bucket beyond which its members are compared with all in reach, block by block.
CROWDED = 2_048
#: Similarities one such block holds.
MATRIX = 4_000_000
#: Up to so many vectors in substrings of 16 bits with two probed, beyond it in overlapping ones of 20 bits with three,
#: which retrieve a pair at least as likely (a test compares them).
SHORT_UP_TO = 2_000_000
#: Neighbours of this cosine the index finds; vectors that have fewer than k of them are compared with all vectors.
SURE = 0.80
#: Such vectors that are broadcast in one pass.
QUERY_BLOCK = 16_384
#: Unit components as 16-bit fixed point.
ONE = 32_767


def layout(n: int) -> tuple[int, int, int]:
    """(bits of a substring, tables, probed bits) for so many vectors."""
    return (16, 9, 2) if n <= SHORT_UP_TO else (20, 9, 3)


def fit_rotation(sample: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation): signs of (x - mean) @ rotation are the code; fitted by alternating signs and rotation.

    The mean of few rows says nothing of the others, so it counts only from four rows a component on.
    """
    mean = sample.mean(0) if len(sample) >= 4 * sample.shape[1] else np.zeros(sample.shape[1])
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=True)
    flat = centred @ axes.T
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(flat.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ w).T
    return mean.astype(np.float32), (axes.T @ turn).astype(np.float32)


def starts(width: int, tables: int) -> list[int]:
    """The first bit of each substring; they cover the code and overlap where they are too many to lie side by side."""
    return [t * (DIMENSION - width) // (tables - 1) for t in range(tables)]


def substrings(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """The value of each substring of each code."""
    weights = (1 << np.arange(width)).astype(np.int64)
    return np.stack([bits[:, at : at + width].astype(np.int64) @ weights for at in starts(width, tables)], 1)


def masks(width: int, probe: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(probe + 1) for c in combinations(range(width), r)]


_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def differing(a: np.ndarray) -> np.ndarray:
    """Set bits of each row of 64-bit words."""
    return _POP[np.ascontiguousarray(a).view(np.uint16)].reshape(len(a), -1).sum(1, dtype=np.int16)


def top(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best j of every i, best first; equal similarities by the smaller j, repeated pairs once."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, s = i[new], j[new], s[new]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], s[keep]


class Search:
    """Best neighbours among the vectors that one task holds."""

    def __init__(self, vectors: np.ndarray, least: float, k: int):
        self.x, self.least, self.k = vectors, least, k
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            sim = np.einsum("nd,nd->n", self.x[a], self.x[b])
            near = sim >= self.least
            self.add(a[near], b[near], sim[near])

    def add(self, i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> None:
        if len(i):
            self.found.append((np.concatenate([i, j]).astype(np.int32), np.concatenate([j, i]).astype(np.int32), np.concatenate([sim, sim]).astype(np.float32)))
            self.held += 2 * len(i)
            if self.held > 4_000_000:
                self.found = [self.best()]
                self.held = len(self.found[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's k best of what was found, best first."""
        if not self.found:
            return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32)
        return top(*(np.concatenate(x) for x in zip(*self.found)), self.k)

    def among(self, rows: np.ndarray, columns: np.ndarray) -> None:
        """The best partners of `rows` among `columns`, all compared in blocks."""
        if not len(rows) or not len(columns):
            return
        columns = np.sort(columns)
        others = np.ascontiguousarray(self.x[columns].T)
        step = min(512, max(1, MATRIX // len(columns)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            sim = self.x[part] @ others
            place = np.minimum(np.searchsorted(columns, part), len(columns) - 1)
            itself = columns[place] == part
            sim[itself, place[itself]] = -2
            edge = np.partition(sim, -self.k, 1)[:, -self.k] if len(columns) > self.k else np.full(len(part), -2, sim.dtype)
            a, b = np.nonzero((sim >= np.maximum(edge, self.least)[:, None]) & (sim > -2))
            self.compare(part[a], columns[b])  # a product's last digits vary with its shape; a pair has one similarity

    def probe(self, keys, words, t, width, probe) -> None:
        """All pairs whose substrings t differ in at most `probe` bits and that no earlier table retrieves.

        The members of a crowded bucket are compared with all that the probes reach, by matrix and not pair by pair,
        so a crowded bucket retrieves what any other does.
        """
        order = np.argsort(keys[:, t], kind="stable")
        sorted_keys = keys[order, t]
        left = np.searchsorted(sorted_keys, sorted_keys, "left")
        right = np.searchsorted(sorted_keys, sorted_keys, "right")
        crowded = right - left > CROWDED
        reach = np.array(masks(width, probe))
        for start in np.unique(left[crowded]):
            inside = order[start : right[start]]
            lo, hi = (np.searchsorted(sorted_keys, sorted_keys[start] ^ reach, side) for side in ("left", "right"))
            near = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
            self.among(inside, order[near])
            self.among(order[near[~crowded[near]]], inside)
        for mask in reach.tolist():
            if mask == 0:
                lo, hi = np.arange(len(order)) + 1, right
            else:
                want = sorted_keys ^ mask
                lo, hi = np.searchsorted(sorted_keys, want, "left"), np.searchsorted(sorted_keys, want, "right")
                hi = np.where(want > sorted_keys, hi, lo)
            many = np.where(crowded, 0, hi - lo)
            todo = np.flatnonzero(many > 0)
            todo = todo[~crowded[lo[todo]]]
            sums = np.cumsum(many[todo])
            begin = 0
            while begin < len(todo):
                stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + 1_000_000)))
                rows = todo[begin:stop]
                n = many[rows]
                a = np.repeat(rows, n)
                b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[rows], n)
                self._retrieved(keys, words, order[a], order[b], t, probe)
                begin = stop

    def _retrieved(self, keys, words, a, b, t, probe) -> None:
        keep = differing(words[a] ^ words[b]) <= RADIUS
        a, b = a[keep], b[keep]
        for earlier in range(t):
            if not len(a):
                return
            fresh = differing((keys[a, earlier] ^ keys[b, earlier]).astype(np.uint64).reshape(-1, 1)) > probe
            a, b = a[fresh], b[fresh]
        self.compare(a, b)


def _unit(batch_column: pa.Array) -> np.ndarray:
    x = batch_column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch_column), DIMENSION).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(vec_id, vector) of the rows of exactly 128 components, all finite and not all zero; null ids are left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(ident).isNotNull() & (F.size(vector) == DIMENSION)).where(fine & F.exists(vector, lambda x: x != 0)).select(F.col(ident).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))


def encode(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, fixed): the binary code and the unit components as 16-bit fixed point."""
    sample = hash_sample(vectors, "vec_id", rows=SAMPLE_ROWS).select("vector").toArrow().column("vector").combine_chunks()
    rows = _unit(sample) if len(sample) else np.eye(DIMENSION)
    mean, turn = fit_rotation(rows)
    fitted = vectors.sparkSession.sparkContext.broadcast((mean, turn))

    def run(batches, fitted=fitted):
        from tarn.llm.neighbours import ONE, _unit

        mean, turn = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("vector"))
            codes = np.packbits((x - mean) @ turn > 0, axis=1)
            fixed = np.round(x * ONE).astype(np.int16)
            as_binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), as_binary(codes), as_binary(fixed)], ["vec_id", "code", "fixed"])

    return vectors.mapInArrow(run, "vec_id bigint, code binary, fixed binary")


_FOUND = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("near", T.ArrayType(T.StructType([T.StructField("s", T.FloatType()), T.StructField("b", T.LongType())])))])


def _search_group(rows: pa.Table, width: int, tables: int, probe: int, least: float, k: int) -> pa.Table:
    ids = rows.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    raw = b"".join(rows.column("code").to_pylist())
    words = np.frombuffer(raw, np.uint64).reshape(len(ids), -1)[order]
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(ids), -1), axis=1)[order]
    x = _components(rows.column("fixed").to_pylist())[order]
    t = rows.column("t")[0].as_py()
    search = Search(x, least, k)
    search.probe(substrings(bits, width, tables), words, t, width, probe)
    i, j, s = search.best()
    cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
    near = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(i)] if len(i) else [0], pa.int32()), pa.StructArray.from_arrays([pa.array(s, pa.float32()), pa.array(ids[j], pa.int64())], ["s", "b"]))
    return pa.table([pa.array(ids[i[cuts]], pa.int64()), near], ["vec_id", "near"])


def _components(fixed: list[bytes]) -> np.ndarray:
    return _floats(np.frombuffer(b"".join(fixed), np.int16).reshape(len(fixed), -1))


def _floats(fixed: np.ndarray) -> np.ndarray:
    x = (fixed / np.float32(ONE)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: A row of a table that is split: its key leads with the bits that name its group.
_ROW = np.dtype([("id", "<i8"), ("words", "<u8", (DIMENSION // 64,)), ("key", "<i8"), ("fixed", "<i2", (DIMENSION,))])


def _filesystem(uri: str):
    """(file system, path) of a place in the shared folder; local files are mapped, not copied."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(system, fs.LocalFileSystem) else system), path


def _binary(column: pa.Array, size: int) -> np.ndarray:
    """The bytes of a column of binary values of one size, a row each."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + size * len(column)].reshape(-1, size)


def _write_segments(batches, folder: str, at: int, width: int, spread: int):
    """Writes rows (vec_id, code, fixed) to files of SEGMENT_ROWS rows ordered by the substring from bit `at`; yields (path, rows of each group)."""
    system, base = _filesystem(folder)
    system.create_dir(base, recursive=True)
    held: list[np.ndarray] = []

    def flush():
        rows = np.concatenate(held)
        held.clear()
        order = np.argsort(rows["key"], kind="stable")
        name = f"{base}/{uuid.uuid4().hex}"
        with system.open_output_stream(name) as out:
            for begin in range(0, len(order), 16_384):
                out.write(rows[order[begin : begin + 16_384]].tobytes())
        counts = np.bincount(rows["key"] >> (width - spread), minlength=1 << spread).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.tobytes()], pa.binary())], ["path", "counts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, _ROW)
        code = _binary(batch.column("code"), DIMENSION // 8)
        value = np.unpackbits(code, axis=1)[:, at : at + width].astype(np.int64) @ (1 << np.arange(width)).astype(np.int64)
        rows["id"], rows["words"] = batch.column("vec_id").to_numpy(), code.view(np.uint64)
        rows["key"] = (value & ((1 << spread) - 1)) << (width - spread) | value >> spread
        rows["fixed"] = _binary(batch.column("fixed"), 2 * DIMENSION).view(np.int16)
        held.append(rows)
        if sum(map(len, held)) >= SEGMENT_ROWS:
            yield flush()
    if held:
        yield flush()


def _units(segments: list[tuple[str, np.ndarray]], most: int) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """(group, [(path, first row, row after the last)]): what one task holds; groups beyond twice `most` rows are split evenly."""
    counts = np.array([c for _, c in segments])
    begins = np.cumsum(counts, 1) - counts
    units = []
    for group, total in enumerate(counts.sum(0).tolist()):
        pieces = -(-total // most) if total > 2 * most else 1
        for piece in range(pieces if total else 0):
            ranges = ((path, b + n * piece // pieces, b + n * (piece + 1) // pieces) for (path, _), b, n in zip(segments, begins[:, group].tolist(), counts[:, group].tolist()))
            units.append((group, [r for r in ranges if r[2] > r[1]]))
    return units


class Unit:
    """Rows of one group of one table, ordered by the rest of their substrings."""

    def __init__(self, system, ranges: list[tuple[str, int, int]], rest: int):
        parts = []
        for path, first, last in ranges:
            with system.open_input_file(path) as file:
                file.seek(first * _ROW.itemsize)
                parts.append(np.frombuffer(file.read_buffer((last - first) * _ROW.itemsize), _ROW))
        rows = np.concatenate(parts)
        local = rows["key"] & ((1 << rest) - 1)
        self.order = np.argsort(local.astype(np.uint16) if rest <= 16 else local, kind="stable").astype(np.int32)
        self.local = local[self.order]
        self.ids = rows["id"][self.order]
        self.words = [np.ascontiguousarray(rows["words"][:, w])[self.order] for w in range(DIMENSION // 64)]
        self.fixed = rows["fixed"]
        self.start = np.searchsorted(self.local, np.arange((1 << rest) + 1)).astype(np.int32)
        self.crowded = np.diff(self.start) > CROWDED

    def __len__(self) -> int:
        return len(self.ids)

    def near(self, bucket: int, reach: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.start[b], self.start[b + 1]) for b in (bucket ^ reach).tolist()])


class Components:
    """Rows of units by their place among all, as unit vectors; only the rows asked for are turned into floats."""

    def __init__(self, *units: Unit):
        self.units = units

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out, first = np.empty((len(rows), DIMENSION), np.int16), 0
        for unit in self.units:
            inside = np.flatnonzero((rows >= first) & (rows < first + len(unit)))
            out[inside] = unit.fixed[unit.order[rows[inside] - first]]
            first += len(unit)
        return _floats(out)


def _meet(home: Unit, other: Unit, reach: list[int], earlier: list[np.ndarray], probe: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best pairs of rows of `home` with rows of `other` (or with each other) whose rests differ by a mask of `reach`
    and that no earlier table retrieves, by places among the rows of both. Crowded buckets are compared by matrix."""
    same = home is other
    shift = 0 if same else len(home)
    search = Search(Components(home) if same else Components(home, other), least, k)
    masks_ = np.array(reach)
    for bucket in np.flatnonzero(home.crowded).tolist():
        inside, near = np.arange(home.start[bucket], home.start[bucket + 1]), other.near(bucket, masks_)
        search.among(inside, near + shift)
        search.among((near[~other.crowded[other.local[near]]] if same else near) + shift, inside)
    for bucket in np.flatnonzero(other.crowded).tolist() if not same else []:
        inside, near = np.arange(other.start[bucket], other.start[bucket + 1]) + shift, home.near(bucket, masks_)
        near = near[~home.crowded[home.local[near]]]
        search.among(inside, near)
        search.among(near, inside)
    for mask in reach:
        want = home.local ^ mask
        lo, hi = other.start[want], other.start[want + 1]
        if same:
            lo = np.arange(1, len(home) + 1, dtype=np.int32) if mask == 0 else lo
            hi = np.where(want >= home.local, hi, lo)
        many = np.where(home.crowded[home.local] | other.crowded[want], 0, hi - lo)
        todo = np.flatnonzero(many > 0)
        sums = np.cumsum(many[todo], dtype=np.int64)
        begin = 0
        while begin < len(todo):
            stop = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + CANDIDATES)))
            rows = todo[begin:stop]
            n = many[rows]
            a = np.repeat(rows.astype(np.int32), n)
            b = np.arange(len(a), dtype=np.int32) + np.repeat(lo[rows] - (np.cumsum(n, dtype=np.int32) - n), n)
            begin = stop
            apart = [h[a] ^ o[b] for h, o in zip(home.words, other.words)]
            kept_ = np.flatnonzero(sum(np.bitwise_count(x) for x in apart) <= RADIUS)
            a, b, apart = a[kept_], b[kept_], [x[kept_] for x in apart]
            for bits in earlier:
                fresh = np.flatnonzero(sum(np.bitwise_count(x & w) for x, w in zip(apart, bits)) > probe)
                a, b, apart = a[fresh], b[fresh], [x[fresh] for x in apart]
            search.compare(a, b + shift)
    return search.best()


def _search_unit(system, units, number: int, t: int, width: int, tables: int, probe: int, spread: int, least: float, k: int):
    """Yields batches (vec_id, s, b): the best pairs within a unit, and with the units in reach that fall to it."""
    rest = width - spread
    bits = np.zeros((tables, DIMENSION), np.uint8)
    for row, at in zip(bits, starts(width, tables)):
        row[at : at + width] = 1
    earlier = list(np.packbits(bits[:t], axis=1).view(np.uint64))
    group, ranges = units[number]
    home = Unit(system, ranges, rest)
    held = []
    for step in range(len(units) // 2 + 1):
        place = (number + step) % len(units)
        apart = (group ^ units[place][0]).bit_count()
        if apart > probe or (2 * step == len(units) and place < number):  # of two units that far apart, the first takes the pair
            continue
        other = Unit(system, units[place][1], rest) if step else home
        i, j, s = _meet(home, other, masks(rest, min(probe - apart, rest)), earlier, probe, least, k)
        ids = np.concatenate([home.ids, other.ids]) if step else home.ids
        own = i < len(home)
        held.append((ids[i[own]], ids[j[own]], s[own]))
        if sum(len(h[0]) for h in held) > 4_000_000:
            held = [top(*(np.concatenate(h) for h in zip(*held)), k)]
        if not own.all():
            yield _flat(ids[i[~own]], ids[j[~own]], s[~own])
    yield _flat(*top(*(np.concatenate(h) for h in zip(*held)), k))


def _flat(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.float32()), pa.array(j, pa.int64())], ["vec_id", "s", "b"])


class Running:
    """The k best partners of stated queries among batches of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, least: float, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.floor = np.full(len(ids), least, np.float32)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]

    def take(self, own: np.ndarray, x: np.ndarray) -> None:
        others = np.ascontiguousarray(x.T)
        step = max(1, MATRIX // len(own))
        for at in range(0, len(self.ids), step):
            sim = self.x[at : at + step] @ others
            sim[self.ids[at : at + step, None] == own[None, :]] = -2
            floor = self.floor[at : at + step]
            if len(own) > self.k:
                floor = np.maximum(floor, np.partition(sim, -self.k, 1)[:, -self.k])
            a, b = np.nonzero((sim >= floor[:, None]) & (sim > -2))
            self.best.append((at + a, own[b], sim[a, b]))
        self.merge()

    def merge(self) -> None:
        q, i, s = (np.concatenate(c) for c in zip(*self.best))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.best = [(q[rank < self.k], i[rank < self.k], s[rank < self.k])]


def exact(queries: DataFrame, encoded: DataFrame, *, k: int, least: float) -> DataFrame:
    """(vec_id, near) of the stated queries (vec_id, fixed) against all of encoded, in broadcast blocks; encoded and queries must be materialised."""
    spark = encoded.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "fixed").toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), b"".join(rows.column("fixed").to_pylist())))

        def run(batches, shared=shared):
            from tarn.llm.neighbours import DIMENSION, Running, _components

            ids, raw = shared.value
            running = Running(ids, _components([raw[at : at + 2 * DIMENSION] for at in range(0, len(raw), 2 * DIMENSION)]), least, k)
            for batch in batches:
                if batch.num_rows:
                    running.take(batch.column("vec_id").to_numpy(), _components(batch.column("fixed").to_pylist()))
            q, i, s = running.best[0]
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(s, pa.float32()), pa.array(i)], ["vec_id", "s", "b"])

        parts.append(encoded.select("vec_id", "fixed").mapInArrow(run, "vec_id bigint, s float, b bigint"))
    if not parts:
        return spark.createDataFrame([], _FOUND)
    return _ranked(reduce(DataFrame.unionByName, parts).groupBy("vec_id").agg(F.collect_list(F.struct("s", "b")).alias("near")), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.select("vec_id", F.slice(F.array_sort("near", lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["b"] < b["b"], -1).when(a["b"] > b["b"], 1).otherwise(0)), 1, k).alias("near"))


def nearest(encoded: DataFrame, *, k: int = K, least: float = -1.0) -> DataFrame:
    """(vec_id, near): up to k (similarity, vec_id) of distinct codes rows, best first; encoded must be materialised.

    The index answers for the vectors that have k neighbours of SURE or more (fewer with a column `need`); if less than
    SURE is asked for, all others are compared with all vectors.
    """
    if least >= SURE:
        return _indexed(encoded, k=k, least=least)
    need = F.col("need") if "need" in encoded.columns else F.lit(k)
    sure = checkpointed(_indexed(encoded, k=k, least=SURE))
    state = encoded.select("vec_id", "fixed", need.alias("need")).join(sure, "vec_id", "left").withColumn("done", F.coalesce(F.size("near"), F.lit(0)) >= F.col("need"))
    lacking = checkpointed(state.where(~F.col("done")).select("vec_id", "fixed"))
    return sure.join(lacking.select("vec_id"), "vec_id", "left_anti").unionByName(exact(lacking, encoded, k=k, least=least))


def _indexed(encoded: DataFrame, *, k: int, least: float) -> DataFrame:
    """(vec_id, near) of the pairs that the substring indexes retrieve."""
    n = encoded.count()
    width, tables, probe = layout(n)
    if n > GROUP_ROWS:
        return _indexed_by_files(encoded, n, k=k, least=least)
    rows = encoded.select("vec_id", "code", "fixed", F.explode(F.array(*map(F.lit, range(tables)))).alias("t"))

    def search(table):
        from tarn.llm.neighbours import _search_group

        return _search_group(table, width, tables, probe, least, k)

    found = rows.groupBy("t").applyInArrow(search, _FOUND)
    best = found.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return _ranked(best, k)


def _indexed_by_files(encoded: DataFrame, n: int, *, k: int, least: float) -> DataFrame:
    """The same for more vectors than one task holds.

    A table's rows are written once, ordered by their substrings, to files in the shared folder. A task holds one group of
    them and reads the groups that its probes reach; so rows that are compared with many groups are read often but never
    copied, and a table's files are removed before the next one is written.
    """
    spark = encoded.sparkSession
    width, tables, probe = layout(n)
    spread = 0
    while n >> spread > GROUP_ROWS and spread < width:
        spread += 1
    writers = max(spark.sparkContext.defaultParallelism, -(-n // SEGMENT_ROWS))
    found, held = [], 0
    for t, at in enumerate(starts(width, tables)):
        folder = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"

        def write(batches, folder=folder, at=at):
            from tarn.llm.neighbours import _write_segments

            return _write_segments(batches, folder, at, width, spread)

        segments = [(r.path, np.frombuffer(r.counts, np.int64)) for r in encoded.select("vec_id", "code", "fixed").coalesce(writers).mapInArrow(write, "path string, counts binary").collect()]
        units = _units(sorted(segments, key=lambda x: x[0]), GROUP_ROWS)
        shared = spark.sparkContext.broadcast(units)

        def search(batches, folder=folder, shared=shared, t=t):
            from tarn.llm.neighbours import _filesystem, _search_unit

            system, _ = _filesystem(folder)
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    yield from _search_unit(system, shared.value, number, t, width, tables, probe, spread, least, k)

        found.append(kept(spark.range(0, len(units), 1, len(units)).mapInArrow(search, "vec_id bigint, s float, b bigint")))
        shared.destroy()
        removed(spark, folder)
        held += found[-1].count()
        if held > 4 * k * n and t < tables - 1:  # a row's best of several tables are as many as those of one
            best = kept(_best(found, k).select("vec_id", F.explode("near").alias("n")).select("vec_id", "n.s", "n.b"))
            for part in found:
                dropped(part)
            found, held = [best], 0
    return _best(found, k)


def _best(found: list[DataFrame], k: int) -> DataFrame:
    return _ranked(reduce(DataFrame.unionByName, found).groupBy("vec_id").agg(F.collect_set(F.struct("s", "b")).alias("near")), k)


def neighbours(vectors: DataFrame, *, k: int = K, least: float = -1.0, ident: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(vec_id, neighbour, cosine): up to k most similar other vectors of every usable vector, of at least `least`.

    Unusable rows (null, wrong length, not finite, all zero) take no part; repeated rows count once; equal
    similarities are settled by the smaller id; fewer than two vectors give no row. Identical vectors are searched
    once: each of them has the smallest ids among its copies as partners, then the neighbours of their common
    vector, so that a group of copies of any size costs rows in proportion. Extra columns are not read.
    """
    ship_package(vectors.sparkSession)
    encoded = kept(encode(usable(vectors, ident, vector)).withColumns({"h": F.xxhash64("fixed"), "h2": F.xxhash64(F.lit("second"), "fixed"), "row": F.monotonically_increasing_id()}))
    # equal vectors are those of the same two hashes (128 bits): the vectors themselves are not sent for it
    members = checkpointed(encoded.groupBy("h", "h2", "vec_id").agg(F.min("row").alias("row")))
    rows, distinct = encoded.count(), members.select("h", "h2").distinct().count()
    if rows == distinct:
        found = nearest(encoded.select("vec_id", "code", "fixed"), k=k, least=least)
        return found.select("vec_id", F.explode("near").alias("n")).select("vec_id", F.col("n.b").alias("neighbour"), F.col("n.s").cast("double").alias("cosine"))
    lowest = members.withColumn("_r", F.row_number().over(Window.partitionBy("h", "h2").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    groups = checkpointed(lowest.groupBy("h", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("low"), F.min_by("row", "vec_id").alias("row")).withColumn("rep", F.element_at("low", 1)))
    first = kept(encoded.join(groups.select("row", "rep", (F.lit(k + 1) - F.size("low")).alias("need")), "row").select(F.col("rep").alias("vec_id"), "code", "fixed", "need"))
    dropped(encoded)
    found = nearest(first, k=k, least=least)
    outer = found.select(F.col("vec_id").alias("rep"), F.posexplode("near").alias("pos", "n")).join(groups.select(F.col("rep").alias("other"), F.col("low").alias("theirs")), F.col("n.b") == F.col("other"))
    outer = outer.groupBy("rep").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "theirs", F.col("n.s").alias("s")))), lambda x: F.transform(x["theirs"], lambda y: F.struct(y.alias("b"), x["s"].alias("s"))))).alias("others"))
    plan = groups.join(outer, "rep", "left").select("h", "h2", F.concat(F.transform("low", lambda y: F.struct(y.alias("b"), F.lit(1.0).cast("float").alias("s"))), F.coalesce("others", F.array().cast("array<struct<b:bigint,s:float>>"))).alias("partners"))
    each = members.select("h", "h2", "vec_id").join(plan, ["h", "h2"]).select("vec_id", F.explode(F.slice(F.filter("partners", lambda p: p["b"] != F.col("vec_id")), 1, k)).alias("p"))
    return each.select("vec_id", F.col("p.b").alias("neighbour"), F.col("p.s").cast("double").alias("cosine")).where(F.col("cosine") >= least)


def similar_pairs(vectors: DataFrame, *, k: int = K, least: float = 0.80) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: pairs of at least `least` of which one is among the k most similar of the other."""
    found = neighbours(vectors, k=k, least=least)
    return found.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
