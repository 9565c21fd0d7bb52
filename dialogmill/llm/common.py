"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the space and the ASCII controls 9-13.
WORD = r"[^ \x09-\x0D]+"
#: The characters that a word can't hold.
BLANKS = " \t\n\x0b\f\r"
#: Arrow batches hold at most so many rows, since single texts can be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; a cluster gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='dialogmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage and keeps what was computed when executors are lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare_python(spark: SparkSession) -> None:
    """Before the first Python operator: send this package to the executors and bound the Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
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


def bucket_bits(n_rows: int, per_bucket: int = 4096) -> int:
    """Bits of a hash that deal ``n_rows`` into buckets of about ``per_bucket`` rows."""
    return min(32, max(0, (max(1, n_rows) // per_bucket)).bit_length())


def ranked(df: DataFrame, parts: list[str], order: list[str], bucket: str, rank: str, weight: str | None = None, total: str | None = None) -> DataFrame:
    """Zero-based gapless ``rank`` of each row within ``parts``, and optionally the running ``total`` of ``weight``.

    No task sees a whole part: rows are dealt by (parts, bucket), only the sums of buckets are
    accumulated over a part, and rows are numbered inside their bucket. ``bucket`` must not
    decrease along ``order``.
    """
    from pyspark.sql import Window

    sums = [F.count(F.lit(1)).alias("__n")] + ([F.sum(weight).alias("__w")] if weight else [])
    per = df.groupBy(*parts, bucket).agg(*sums)
    run = Window.partitionBy(*parts).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*parts, bucket])], F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"), *([F.coalesce(F.sum("__w").over(run), F.lit(0)).alias("__w_before")] if weight else []))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*parts, bucket])]
    inside = Window.partitionBy(*parts, bucket).orderBy(*order)
    out = df.join(per, on).withColumn(rank, (F.col("__before") + F.row_number().over(inside) - 1).cast("long"))
    if weight:
        out = out.withColumn(total, F.col("__w_before") + F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.drop("__before", "__w_before", *[f"__k{i}" for i in range(len(parts) + 1)])
