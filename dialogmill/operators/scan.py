"""Running sums, last values and counts along an order, without a part's rows in one task.

Rows are dealt into blocks along the order; a block is a task's work. What a block adds up to is a row, the rows of blocks are added up
over a part (in two steps, so that even these don't all meet), and each block starts from what the blocks before it have left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.operators.state import kept

BLOCK = "__block"
#: So many rows make a block, so many blocks are added up at once.
ROWS, SPAN = 100_000, 1024


def dealt(rows: DataFrame, parts: list[str], order: list[str], per: int = ROWS) -> DataFrame:
    """The rows, written, in blocks of about ``per`` that follow each other along (parts, order). A long part spans several blocks, short ones share one."""
    spark = rows.sparkSession
    rows = kept(rows, "scan-rows")
    n = max(1, -(-rows.count() // per))
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")) if n > 1 else 1)
    return kept(rows.repartitionByRange(n, *parts, *order).withColumn(BLOCK, F.spark_partition_id().cast("long")), "scan-blocks")


def _keys(parts: list[str]) -> list[str]:
    return [*parts, BLOCK]


def _joined(rows: DataFrame, carried: DataFrame, parts: list[str]) -> DataFrame:
    names = {c: f"__k{i}" for i, c in enumerate(_keys(parts))}
    right = carried.withColumnsRenamed(names)
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    return rows.join(right, on, "left").drop(*names.values())


def sums_before(rows: DataFrame, parts: list[str], order: list[str], sums: dict[str, Column], running: bool = False, blocks: int | None = None) -> DataFrame:
    """Adds columns: sums over the part's rows before each row, or, ``running``, up to and with it. ``rows`` has blocks; ``order`` must not have ties within a part.

    ``blocks``: their number, if it is known; a single one needs no adding up.
    """
    if blocks == 1:
        over = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if running else -1)
        return rows.withColumns({n: F.coalesce(F.sum(c).over(over), F.lit(0)) for n, c in sums.items()})
    valued = rows.withColumns({f"__v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    per = valued.groupBy(*_keys(parts)).agg(*[F.sum(f"__v_{n}").alias(n) for n in sums])
    per = per.withColumn("__span", F.floor(F.col(BLOCK) / SPAN))
    spans = per.groupBy(*parts, "__span").agg(*[F.sum(n).alias(f"__s_{n}") for n in sums])
    over = Window.partitionBy(*parts).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parts)], F.col("__span").alias("__of"), *[F.coalesce(F.sum(f"__s_{n}").over(over), F.lit(0)).alias(f"__s_{n}") for n in sums])
    within = Window.partitionBy(*parts, "__span").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*_keys(parts), "__span", *[F.coalesce(F.sum(n).over(within), F.lit(0)).alias(f"__b_{n}") for n in sums])
    per = per.join(spans, [F.col("__span") == F.col("__of"), *[F.col(p).eqNullSafe(F.col(f"__p{i}")) for i, p in enumerate(parts)]])
    per = per.select(*_keys(parts), *[(F.col(f"__b_{n}") + F.col(f"__s_{n}")).alias(f"__c_{n}") for n in sums])
    local = Window.partitionBy(*_keys(parts)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if running else -1)
    out = _joined(valued, per, parts).withColumns({n: F.col(f"__c_{n}") + F.coalesce(F.sum(f"__v_{n}").over(local), F.lit(0)) for n in sums})
    return out.drop(*[f"__{k}_{n}" for k in "vc" for n in sums])


def last_before(rows: DataFrame, parts: list[str], order: list[str], values: dict[str, Column], running: bool = False) -> DataFrame:
    """Adds columns: the last value that isn't null of the part's rows before each row, or, ``running``, up to and with it."""
    valued = rows.withColumns({f"__v_{n}": c for n, c in values.items()})
    at = F.struct(*order)
    per = valued.groupBy(*_keys(parts)).agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(n) for n in values]).withColumn("__span", F.floor(F.col(BLOCK) / SPAN))
    spans = per.groupBy(*parts, "__span").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(BLOCK))).alias(f"__s_{n}") for n in values])
    over = Window.partitionBy(*parts).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parts)], F.col("__span").alias("__of"), *[F.last(f"__s_{n}", ignorenulls=True).over(over).alias(f"__s_{n}") for n in values])
    within = Window.partitionBy(*parts, "__span").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*_keys(parts), "__span", *[F.last(n, ignorenulls=True).over(within).alias(f"__b_{n}") for n in values])
    per = per.join(spans, [F.col("__span") == F.col("__of"), *[F.col(p).eqNullSafe(F.col(f"__p{i}")) for i, p in enumerate(parts)]])
    per = per.select(*_keys(parts), *[F.coalesce(f"__b_{n}", f"__s_{n}").alias(f"__c_{n}") for n in values])
    local = Window.partitionBy(*_keys(parts)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if running else -1)
    out = _joined(valued, per, parts).withColumns({n: F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(local), f"__c_{n}") for n in values})
    return out.drop(*[f"__{k}_{n}" for k in "vc" for n in values])


def numbered(rows: DataFrame, parts: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of rows of the part before each row."""
    return sums_before(rows, parts, order, {name: F.lit(1)})


def with_halo(rows: DataFrame, parts: list[str], order: list[str], before: int, per: int = ROWS) -> DataFrame:
    """The rows in pieces of each part, ``__piece``, each with copies (``__halo``) of the ``before`` rows that come before its own; a frame of so many rows stays in a piece."""
    per = max(per, before)
    at = numbered(dealt(rows, parts, order), parts, order, "__at").drop(BLOCK)
    own = F.floor(F.col("__at") / per)
    ahead = F.when(F.col("__at") % per >= per - before, own + 1)
    copies = F.filter(F.array(F.struct(own.alias("piece"), F.lit(False).alias("halo")), F.struct(ahead.alias("piece"), F.lit(True).alias("halo"))), lambda x: x["piece"].isNotNull())
    return at.withColumn("__x", F.explode(copies)).withColumns({"__piece": F.col("__x.piece"), "__halo": F.col("__x.halo")}).drop("__x", "__at")


def in_time_pieces(rows: DataFrame, parts: list[str], ms: str, width: int, factor: int = 64) -> DataFrame:
    """The rows in pieces of time, ``__piece``, of ``factor`` widths, with copies (``__halo``) of those that the next piece's frames of one width reach back to."""
    length = width * factor
    own = F.floor(F.col(ms) / length)
    ahead = F.when(F.pmod(F.col(ms), F.lit(length)) >= length - width, own + 1)
    copies = F.filter(F.array(F.struct(own.alias("piece"), F.lit(False).alias("halo")), F.struct(ahead.alias("piece"), F.lit(True).alias("halo"))), lambda x: x["piece"].isNotNull())
    return rows.withColumn("__x", F.explode(copies)).withColumns({"__piece": F.col("__x.piece"), "__halo": F.col("__x.halo")}).drop("__x")
