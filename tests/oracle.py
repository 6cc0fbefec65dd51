"""Comparison of queries with their SQL on the same tables."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings source_list fetch_log page_nodes corpus_docs golden_set retrieved_chunks embed_index chunk_vectors eval_items fact_labels".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return v


def same(df, con, sql):
    names = sorted(df.columns)
    ours = sorted((tuple(cell(r[c]) for c in names) for r in df.collect()), key=str)
    cur = con.execute(sql)
    have = [x[0] for x in cur.description]
    assert sorted(have) == names
    theirs = sorted((tuple(cell(r[have.index(c)]) for c in names) for r in cur.fetchall()), key=str)
    assert ours == theirs
    return len(ours)
