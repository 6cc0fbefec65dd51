"""Dense vectors: validity, norms, exact filtered search, the vector cache and keyed upserts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that may be broadcast in one pass; more are searched pass by pass.
QUERY_BLOCK = 4_096


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def normalised(v: Column) -> Column:
    """The vector over its norm; an all-zero vector stays."""
    # the norm is bound as a variable, so it is computed once for a vector and not once for a component
    over = lambda size: F.transform(v, lambda x: F.when(size == 0, x.cast("double")).otherwise(x.cast("double") / size))
    return F.get(F.transform(F.array(norm(v)), over), F.lit(0))


def is_valid(v: Column, dimension: int) -> Column:
    """Right length, no null, no NaN, nothing infinite. NULL vectors are not valid."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matching(df: DataFrame, where: dict, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose columns equal the values of `where`; null stands for ''. Unknown keys are an error. Pushed to the scan."""
    unknown = set(where) - set(allowed)
    if unknown:
        raise KeyError(f"no filter on {sorted(unknown)}")
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit("" if kv[1] is None else kv[1])), where.items(), df)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, same_label: bool = False) -> DataFrame:
    """(q, id, sim, rank): the k most similar rows of vectors (id, v[, label]) for each query (q, v[, label]).

    Exact. The stated queries go in blocks of QUERY_BLOCK, each broadcast, against all vectors: a task multiplies its
    batch with the block and keeps k rows per query, so what is shuffled is k rows per query and task. A row is no
    neighbour of the query with its own id. Ties go to the smaller id. Null vectors take no part.
    """
    spark = vectors.sparkSession
    total = queries.where("v is not null").count()
    parts = []
    blocks = max(1, -(-total // QUERY_BLOCK))
    for block in range(blocks):
        rows = queries.where("v is not null").where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "v", *(["label"] if same_label else [])).toArrow()
        if not rows.num_rows:
            continue
        ids = np.array(rows.column("q").to_pylist(), np.int64)
        m = np.array(rows.column("v").to_pylist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        labels = np.array(rows.column("label").to_pylist()) if same_label else None
        shared = spark.sparkContext.broadcast((ids, m, labels))

        def run(batches, shared=shared, k=k):
            ids, m, labels = shared.value
            best: list = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.array(batch.column("id").to_pylist(), np.int64)
                x = np.array(batch.column("v").to_pylist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sim = m @ x.T
                sim[ids[:, None] == own[None, :]] = -2
                if labels is not None:
                    sim[labels[:, None] != np.array(batch.column("label").to_pylist())[None, :]] = -2
                top = np.argsort(-sim, axis=1, kind="stable")[:, : 4 * k] if sim.shape[1] <= 4 * k else np.argpartition(-sim, 4 * k, axis=1)[:, : 4 * k]
                edge = np.sort(np.take_along_axis(sim, top, 1), axis=1)[:, ::-1][:, : k][:, -1]
                a, b = np.nonzero((sim >= edge[:, None] - 1e-12) & (sim > -2))
                best.append((ids[a], own[b], sim[a, b]))
            if best:
                q, i, s = (np.concatenate(c) for c in zip(*best))
                order = np.lexsort((i, -s.round(9), q))
                q, i, s = q[order], i[order], s[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (q, i, s)], ["q", "id", "sim"])

        parts.append(vectors.where("v is not null").select("id", "v", *(["label"] if same_label else [])).mapInArrow(run, "q bigint, id bigint, sim double"))
    if not parts:
        return spark.createDataFrame([], T.StructType.fromDDL("q bigint, id bigint, sim double, rank int"))
    ranked = reduce(DataFrame.unionByName, parts).withColumn("sim", F.round("sim", 6))
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(q, id, sim): all rows of vectors (id, v) whose rounded similarity to a query (q, v) is `least` or more.

    Exact and without a bound on the partners of a query. The stated queries go in blocks of QUERY_BLOCK, each
    broadcast, against all vectors. A row is no partner of the query with its own id. Null vectors take no part.
    """
    spark = vectors.sparkSession
    total = queries.where("v is not null").count()
    parts = []
    blocks = max(1, -(-total // QUERY_BLOCK))
    for block in range(blocks):
        rows = queries.where("v is not null").where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "v").toArrow()
        if not rows.num_rows:
            continue
        ids = np.array(rows.column("q").to_pylist(), np.int64)
        m = np.array(rows.column("v").to_pylist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches, shared=shared, least=least):
            ids, m = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.array(batch.column("id").to_pylist(), np.int64)
                x = np.array(batch.column("v").to_pylist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                for at in range(0, len(ids), 256):
                    sim = m[at : at + 256] @ x.T
                    a, b = np.nonzero((sim >= least - 1e-6) & (ids[at : at + 256, None] != own[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[at + a], own[b], sim[a, b])], ["q", "id", "sim"])

        parts.append(vectors.where("v is not null").select("id", "v").mapInArrow(run, "q bigint, id bigint, sim double"))
    if not parts:
        return spark.createDataFrame([], "q bigint, id bigint, sim double")
    return reduce(DataFrame.unionByName, parts).withColumn("sim", F.round("sim", 6)).where(F.col("sim") >= least)


def cache_misses(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The distinct keys that have no stored vector yet; nulls are no keys."""
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(stored.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def upserted(base: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """base with the rows of delta: for each key the row of the highest version, the new one if they are equal."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    columns = [c for c in base.columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(F.col(version), F.col("_new"))).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def rebuilt(store: DataFrame, current: DataFrame, key: list[str], version: str) -> DataFrame:
    """The store brought to the keys of current: orphans are deleted, rows upserted, the stored row kept if it is newer."""
    alive = current.select(*key).where(" and ".join(f"`{k}` is not null" for k in key)).distinct()
    return upserted(store.join(alive, key, "left_semi"), current.join(alive, key, "left_semi").select(*store.columns), key, version)


def gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state): `missing` keys stand only left, `orphan` keys only right."""
    a = left.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_l", F.lit(1))
    b = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").where("_l is null or _r is null").select(key, F.when(F.col("_r").isNull(), "missing").otherwise("orphan").alias("state"))
