"""Streams: windowed counts with late data, sessions, and keyed upserts of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.session import checkpoint_dir


def _timely(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on its stamps; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and summed values by window and type; rows later than `late` are left out of a stream. Batch input works too."""
    kind = events.schema["ts"].dataType.simpleString()
    rows = _timely(events, late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: a gap without events ends one."""
    kind = events.schema["ts"].dataType.simpleString()
    rows = _timely(events, late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").cast(kind).alias("start"), "n")


def first_seen(pages: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the lateness; in a stream the state of older keys is dropped."""
    return pages.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if pages.isStreaming else pages.dropDuplicates([key])


def upsert_stream(stream: DataFrame, folder: str, key: str, version: str, name: str) -> StreamingQuery:
    """Keeps in `folder` the row of the highest version of each key: every batch is merged with the latest state there.

    A state is a folder of its own, v0, v1 and so on, complete once it has _SUCCESS; a stream with a fresh checkpoint
    goes on from the latest. Merging a batch twice changes nothing. The state before the latest is kept for readers,
    older ones are removed.
    """
    spark = stream.sparkSession
    base = checkpoint_dir(spark)

    def states() -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*/_SUCCESS")) or []
        return sorted(int(x.getPath().getParent().getName()[1:]) for x in found)

    def merge(batch: DataFrame, number: int) -> None:
        fields = [c for c in batch.columns if c != key]
        there = states()
        rows = spark.read.schema(batch.schema).parquet(f"{folder}/v{there[-1]}").unionByName(batch) if there else batch
        best = rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(version)).alias("r")).select(key, "r.*")
        best.write.mode("overwrite").parquet(f"{folder}/v{there[-1] + 1 if there else 0}")
        for old in there[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/stream-{name}").trigger(availableNow=True).start()
