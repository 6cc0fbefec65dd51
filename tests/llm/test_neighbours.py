import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import neighbours as N


def clusters(count, size, seed=3, spread=0.25):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(count, 128))
    x = np.repeat(centres, size, 0) + spread * r.normal(size=(count * size, 128))
    return (x * r.uniform(0.3, 4, size=(len(x), 1))).astype(np.float32)


def truth(x, k=5, least=0.8):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((min(i, j), max(i, j)))
    return out


def frame(spark, x, extra=()):
    rows = [(i, f"f{i}", [float(v) for v in v_]) for i, v_ in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, code string, vector array<float>")


@pytest.mark.parametrize("group", [65_536, 300])
def test_recall_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(N, "GROUP_ROWS", group)
    x = clusters(150, 8)
    bad = [(9000, "n", None), (9001, "s", [1.0] * 64), (9002, "z", [0.0] * 128), (9003, "i", [float("inf")] + [1.0] * 127), (9004, "q", [float("nan")] + [1.0] * 127), (0, "f0", [float(v) for v in x[0]]), (None, "x", [1.0] * 128)]
    got = {(r.vec_a, r.vec_b) for r in N.similar_pairs(frame(spark, x, bad)).collect()}
    want = truth(x)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWDED", 64)
    x = np.concatenate([clusters(1, 500, spread=0.2), clusters(40, 8, seed=5)])
    got = {(r.vec_a, r.vec_b) for r in N.similar_pairs(frame(spark, x)).collect()}
    want = truth(x)
    assert len(got & want) >= 0.9 * len(want)


def test_copies_cost_rows_in_proportion(spark):
    x = clusters(30, 4)
    x = np.concatenate([x, np.repeat(x[:1], 60, 0), np.repeat(x[5:6], 2, 0)])
    rows = N.neighbours(frame(spark, x), least=0.8)
    by = {}
    for r in rows.collect():
        by.setdefault(r.vec_id, []).append(r)
    copies = [0, *range(120, 180)]
    for i in copies:
        assert sorted(r.neighbour for r in by[i]) == [c for c in copies if c != i][:5] and all(r.cosine == 1.0 for r in by[i])
    assert {r.neighbour for r in by[5]} >= {180, 181} and len(by[5]) == 5
    assert len(by[1]) == 5 and all(r.neighbour in copies for r in by[1] if r.neighbour not in (2, 3))


def test_few_vectors(spark):
    empty = frame(spark, clusters(1, 1)).limit(0)
    assert N.similar_pairs(empty).count() == 0
    assert N.similar_pairs(frame(spark, clusters(1, 1))).count() == 0
    assert N.similar_pairs(frame(spark, clusters(1, 2, spread=0.1))).count() == 1


def big_frame(spark, x):
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 128), pa.int32()), pa.array(x.astype(np.float32).ravel()))
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "vector": vectors})).repartition(4)


def recall(found, x, queries, k=5):
    """Share of the true k nearest of `queries` that came out."""
    got = {}
    for r in found.where(F.col("vec_id").isin([int(q) for q in queries])).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[queries] @ u.T
    s[np.arange(len(queries)), queries] = -2
    return np.mean([len(got.get(int(q), set()) & set(np.argsort(-s[n])[:k].tolist())) / k for n, q in enumerate(queries)])


def test_hot_cluster(spark):
    r = np.random.default_rng(7)
    spread = r.uniform(0.02, 0.2, size=(20_000, 1))
    hot = r.normal(size=128) + spread * r.normal(size=(20_000, 128))
    x = np.concatenate([hot, r.normal(size=(10_000, 128))])
    assert recall(N.neighbours(big_frame(spark, x), least=0.8), x, r.choice(20_000, 150, replace=False)) >= 0.98


def test_far_neighbours_come_out(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 200)
    x = np.concatenate([clusters(60, 8), clusters(20, 3, seed=5), np.random.default_rng(9).normal(size=(300, 128))])
    found = N.neighbours(big_frame(spark, x)).cache()
    assert found.count() == 5 * len(x)
    assert recall(found, x, np.arange(len(x))) >= 0.99
    x = np.concatenate([x, x[480:500]])
    assert N.neighbours(big_frame(spark, x)).groupBy("vec_id").count().where("count = 5").count() == len(x)


def test_recall_of_the_wide_layout(spark, monkeypatch):
    monkeypatch.setattr(N, "SHORT_UP_TO", 0)
    monkeypatch.setattr(N, "GROUP_ROWS", 100)
    x = clusters(60, 8, spread=0.42)
    want = truth(x)
    got = {(r.vec_a, r.vec_b) for r in N.similar_pairs(big_frame(spark, x)).collect()}
    assert len(got & want) >= 0.97 * len(want)


@pytest.mark.parametrize("cosine", [0.80, 0.85, 0.90])
def test_wide_layout_retrieves_as_much_as_the_narrow_one(cosine):
    r = np.random.default_rng(4)
    a = r.random((50_000, 128)) < 0.5
    b = a ^ (r.random(a.shape) < np.arccos(cosine) / np.pi)
    shares = []
    for n in (N.SHORT_UP_TO, N.SHORT_UP_TO + 1):
        width, tables, probe = N.layout(n)
        apart = N.substrings(a, width, tables) ^ N.substrings(b, width, tables)
        shares.append(np.any([N.differing(x.astype(np.uint64).reshape(-1, 1)) <= probe for x in apart.T], 0).mean())
    assert shares[1] >= shares[0] - 0.002


@pytest.mark.parametrize("group", [65_536, 1_000])
def test_recall_near_the_threshold(spark, monkeypatch, group):
    """Triples of vectors whose cosine lies about 0.80; splitting the groups loses none of them."""
    monkeypatch.setattr(N, "GROUP_ROWS", group)
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(1_500, 128)), 3, 0) + 0.5 * r.normal(size=(4_500, 128))
    want = truth(x)
    got = {(q.vec_a, q.vec_b) for q in N.similar_pairs(big_frame(spark, x)).collect()}
    assert len(want) > 2_000 and len(got & want) >= 0.985 * len(want) and len(got - want) <= 0.002 * len(want)  # components are fixed-point


def sent(spark):
    """Bytes of shuffles written so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_split_tables_are_not_copied_to_the_groups_in_reach(spark, monkeypatch):
    """With 32 groups a row is compared with many of them; what is shuffled stays below the vectors' own size."""
    monkeypatch.setattr(N, "GROUP_ROWS", 125)
    x = clusters(500, 8)
    folders = []
    if hasattr(N, "removed"):
        monkeypatch.setattr(N, "removed", lambda s, path, remove=N.removed: (folders.append(path), remove(s, path)))
    before = sent(spark)
    got = {(r.vec_a, r.vec_b) for r in N.similar_pairs(big_frame(spark, x)).collect()}
    time.sleep(1)
    want = truth(x)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.002 * len(want)
    assert sent(spark) - before < 4 * x.nbytes  # the frame's own repartition, the found pairs
    assert len(folders) == N.layout(len(x))[1] and not any(os.path.exists(f.removeprefix("file:")) for f in folders)


def test_uneven_groups(spark, monkeypatch):
    """A group of many times the rows that a task holds is split, and no pair of its parts is lost."""
    monkeypatch.setattr(N, "GROUP_ROWS", 100)
    x = np.concatenate([clusters(1, 600, spread=0.2), clusters(60, 8, seed=5)])
    found = N.neighbours(big_frame(spark, x), least=0.8)
    assert recall(found, x, np.arange(len(x) - 480)) >= 0.98
