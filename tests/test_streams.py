import datetime as dt
import uuid

from tarn.sources import tables as IO
from tarn.streaming import feeds


def test_json_lines(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "é\n", None), (2, None, 1.5)], "b int, a string, c double")
    IO.write_json_lines(df, f"{tmp_path}/j")
    assert sorted(map(tuple, IO.read_json_lines(spark, f"{tmp_path}/j", df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert IO.read_json_lines(spark, f"{tmp_path}/none", df.schema).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"b": 1}\n\n{broken\n')
    with pytest.raises(Exception):
        IO.read_json_lines(spark, f"{tmp_path}/bad", df.schema).collect()
    assert IO.read_json_lines(spark, f"{tmp_path}/bad", df.schema, strict=False).count() == 1
    assert IO.read_json(f"{tmp_path}/none.json", {"x": 1}) == {"x": 1}


def test_csv_leaves_out_blank_keys(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q", y'), (" ", "z"), (None, "n")], "k string, v string")
    IO.write_csv(df, f"{tmp_path}/c")
    assert [tuple(r) for r in IO.read_csv(spark, f"{tmp_path}/c", df.schema, key="k").collect()] == [("a", 'x "q", y')]


def test_upsert_stream(spark, tmp_path):
    schema = "k long, v string, n int"
    (tmp_path / "in").mkdir()
    name = f"t-{uuid.uuid4().hex}"  # checkpoints outlive a test run where the session names a folder for them
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (2, "old", 0), (3, "d", 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feeds.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "k", "n", name).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out/v1").collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_sessions(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(minutes=29)), (1, t + dt.timedelta(minutes=80)), (2, t)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp")
    assert sorted((r.user_id, r.n) for r in feeds.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert feeds.first_seen(df, "user_id", "ts").count() == 2
