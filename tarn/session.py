"""Session, table access and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, adaptive execution, Arrow batches."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a session of one machine gets a folder of its own; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tarn-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder so that a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """The rows of df as a table written to the shared folder: compressed, read by columns, safe from lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder that is read no more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(table: DataFrame) -> None:
    """Removes a table made by kept() that is read no more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        removed(table.sparkSession, folder)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor (once for a session)."""
    context = spark.sparkContext
    if getattr(context, "_tarn_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tarn-zip-"), f"tarn_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.join("tarn", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._tarn_shipped = True


def hash_sample(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """About `rows` rows of df (never more), chosen by the hash of their keys, the same on every run.

    Rows are kept by a threshold on the hash, so no task sends more than its share to anyone.
    """
    from pyspark.sql import functions as F

    total = df.count()
    if total <= rows:
        return df
    share = rows / total
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) < int(share * 1_000_003)).limit(rows)
