"""Readers and writers of the plain formats: JSON lines, CSV, and one-document JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType, *, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines folder. A missing path gives no rows; a corrupt line fails, or (strict=False) is left out."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_json_lines(df: DataFrame, path: str, *, append: bool = False) -> None:
    """Rows as JSON lines with sorted keys; null fields are left out."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, *, key: str | None = None) -> DataFrame:
    """Rows of a CSV with a header; rows with a blank key are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return rows.where(f"{key} is not null and trim({key}) <> ''") if key else rows


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(path: str, default=None):
    """One small JSON document; the default if it is missing."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)
