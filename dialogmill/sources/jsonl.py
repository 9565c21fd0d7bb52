"""JSON and JSONL tables, reports and key-value caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """One object a line; lines that are no JSON objects are left out. A missing file has no rows, or is an error."""
    try:
        raw = spark.read.text(path)
    except Exception:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise
    line = F.regexp_replace("value", "^\\uFEFF", "")
    rows = raw.select(F.from_json(line, f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"), F.trim(line).alias("t"))
    return rows.where(F.col("t").startswith("{") & F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def corrupt_lines(spark: SparkSession, path: str, schema: str) -> int:
    """Lines with text that read_jsonl() leaves out."""
    return spark.read.text(path).where(F.trim("value") != "").count() - read_jsonl(spark, path, schema).count()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files with one object each."""
    return spark.read.schema(f"{schema}, {CORRUPT} STRING").option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as a JSON line."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def load_config(text: str) -> dict:
    """A configuration: JSON, else YAML; anything but a mapping is an error."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration is a mapping")
    return found


def cached(rows: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """rows with ``cached``: the value of the cache (key, value) at the SHA-1 of the text; null at a miss."""
    keyed = rows.withColumn("__k", F.sha1(F.col(text).cast("binary")))
    return keyed.join(cache.select(F.col("key").alias("__k"), F.col("value").alias("cached")), "__k", "left").drop("__k")


def save_misses(rows: DataFrame, cache: DataFrame, text: str, value: str) -> DataFrame:
    """The cache (key, value) with what was found for texts it didn't have; empty and missing values aren't kept."""
    found = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.sha1(F.col(text).cast("binary")).alias("key")).agg(F.min(value).alias("value"))
    return cache.select("key", "value").unionByName(found.join(cache.select("key"), "key", "left_anti"))


def non_blank_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()
