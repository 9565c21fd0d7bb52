"""Merges of a stream's batches into a table, by foreachBatch.

The table is a folder of versions: a batch rewrites the hash buckets that its keys fall into and writes down, last of all, which version of each
bucket holds. So a batch that is run again after a failure finds itself done, or does all of it over, and buckets without new rows aren't touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MergedTable:
    """A row for each key with the last present value of each field, by the order column ``at``; equal orders go to the greater value."""

    def __init__(self, spark: SparkSession, base: str, schema: str, keys: list[str], at: str, fields: list[str], buckets: int = 64):
        self.spark, self.base, self.keys, self.at, self.fields, self.buckets = spark, base.rstrip("/"), keys, at, fields, buckets
        self.empty = spark.createDataFrame([], schema).select(*keys, at, *fields)

    def _held(self, rows: DataFrame) -> DataFrame:
        """Each field with its order, so that merges of merges are merges."""
        return rows.select(*self.keys, *[F.when(F.col(f).isNotNull(), F.struct(F.col(self.at).alias("at"), F.col(f).alias("value"))).alias(f) for f in self.fields], F.col(self.at).alias("__at"))

    def _committed(self) -> list[int]:
        jvm, path = self.spark._jvm, f"{self.base}/versions"
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        done = [n for n in names if n.startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def versions(self) -> dict[int, int]:
        """bucket -> the batch whose files hold it; a row for each bucket, of which there is a fixed number."""
        done = self._committed()
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.base}/versions/batch={done[-1]}").collect()} if done else {}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.base}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        start = self._held(self.empty)
        return self.spark.read.schema(start.schema).parquet(*paths) if paths else start

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        done = self._committed()
        if done and batch_id <= done[-1]:
            return
        versions = self.versions()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = self._held(batch).persist()
        changed = [r["bucket"] for r in fresh.select(bucket).distinct().collect()]
        both = fresh.unionByName(self._read({b: v for b, v in versions.items() if b in changed}))
        merged = both.groupBy(*self.keys).agg(*[F.max(f).alias(f) for f in self.fields], F.max("__at").alias("__at")).withColumn("bucket", bucket)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/rows/version={batch_id}")
        now = versions | dict.fromkeys(changed, batch_id)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/versions/batch={batch_id}")
        fresh.unpersist()

    def rows(self) -> DataFrame:
        """keys, the last order ``at``, fields."""
        return self._read(self.versions()).select(*self.keys, F.col("__at").alias(self.at), *[F.col(f"{f}.value").alias(f) for f in self.fields])


def merge(stream: DataFrame, table: MergedTable, checkpoint: str) -> DataFrame:
    """The table after all of the stream's rows that are there now."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: table.apply(df, i)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return table.rows()
