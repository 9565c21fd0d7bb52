"""State that outlives executors: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local master only, which is then set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='dialogmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, label: str = "state") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether a table has ``most`` rows at most; no more than that are counted."""
    return df.limit(most + 1).count() <= most
