"""Runs a streaming query over what its source has and returns its rows."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from dialogmill.operators.state import shared_folder


def send_package(spark: SparkSession) -> None:
    """This package to the executors, once, for functions that run in Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_dialogmill_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="dialogmill-"), "dialogmill.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._dialogmill_sent = True


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; a streaming query keeps those with which it began."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def available_now(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], mode: str, conf: dict[str, str] | None = None, progress: list | None = None) -> DataFrame:
    """Append-mode rows go to a Parquet sink with exactly-once commits; complete-mode results replace a table each batch.

    ``conf``: settings for this query; ``progress`` gets the progress of its batches.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = operator(stream)
    writer = out.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    with settings(spark, conf or {}):
        if mode == "append":
            q = writer.outputMode("append").format("parquet").option("path", f"{base}/rows").start()
        else:
            q = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows")).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if progress is not None:
        progress += q.recentProgress
    return spark.read.schema(out.schema).parquet(f"{base}/rows")
