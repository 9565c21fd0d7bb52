"""Time-ordered event operators on tables: as-of matches, interval matches, gap sessions, last-K buffers, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.operators import scan


def as_of(rows: DataFrame, parts: list[str], ms: str, rights: dict[str, tuple[Column, list[str]]], per: int = scan.ROWS) -> DataFrame:
    """Adds a struct for each of ``rights`` (name -> (condition, fields)): the fields of the last row before this one that meets the condition; rows with equal times in id order.

    A part's rows are dealt into blocks along the time, so a part of any size is the work of many tasks.
    """
    order = [ms, "event_id"]
    blocks = scan.dealt(rows, parts, order, per)
    return scan.last_before(blocks, parts, order, {name: F.when(when, F.struct(*fields)) for name, (when, fields) in rights.items()}).drop(scan.BLOCK)


def echoes(similarity: Column, window_ms: int = 3000, least: float = 0.86, diag_ms: int = 2000) -> Column:
    """Whether a self utterance repeats the last remote one: near in time, similar, and no louder than leakage.

    The rows carry ms and the structs remote (ms) and diag (ms, self_rms, remote_rms), as as_of() adds them.
    """
    near = (F.abs(F.col("ms") - F.col("remote.ms")) <= window_ms) & (similarity >= least)
    quiet = F.greatest(F.lit(0.0), F.col("diag.self_rms")) <= F.greatest(F.lit(160.0), F.greatest(F.lit(0.0), F.col("diag.remote_rms")) * 0.45)
    return F.coalesce(near & (F.abs(F.col("diag.ms") - F.col("ms")) <= diag_ms) & quiet, F.lit(False))


def within(left: DataFrame, right: DataFrame, key: str, ms: str, hold_ms: int) -> DataFrame:
    """Pairs of a left row and a right row of the same key that follows by at most ``hold_ms``.

    Times are dealt into buckets as wide as the interval; a right row stands in its own bucket and the one
    before, so the join is an equality and no key's rows all meet.
    """
    a = left.withColumn("__b", F.floor(F.col(ms) / hold_ms))
    b = right.select(F.col(key).alias("__k"), F.col(ms).alias("right_ms"), F.col("event_id").alias("right_id"))
    b = b.withColumn("__rb", F.explode(F.array(F.floor(F.col("right_ms") / hold_ms), F.floor(F.col("right_ms") / hold_ms) - 1)))
    on = (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__rb")) & (F.col("right_ms") >= F.col(ms)) & (F.col("right_ms") <= F.col(ms) + hold_ms)
    return a.join(b, on).drop("__b", "__k", "__rb")


def gap_sessions(rows: DataFrame, parts: list[str], ms: str, gap: Column | int, per: int = scan.ROWS) -> DataFrame:
    """Adds ``session`` (from 1): a new one begins where the time since the row before is over the gap, which a row may set for its successor. Parts of any size are dealt into blocks."""
    order = [ms, "event_id"]
    blocks = scan.dealt(rows, parts, order, per)
    limit = gap if isinstance(gap, Column) else F.lit(gap)
    blocks = scan.last_before(blocks, parts, order, {"__before": F.struct(F.col(ms).alias("ms"), limit.alias("gap"))})
    opens = F.when(F.col(ms) - F.col("__before.ms") <= F.col("__before.gap"), 0).otherwise(1)
    return scan.sums_before(blocks, parts, order, {"session": opens}, running=True).drop("__before", scan.BLOCK)


def last_rows(rows: DataFrame, parts: list[str], order: list[Column], k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return rows.withColumn("__rn", rn).where(F.col("__rn") <= k).drop("__rn")


def upsert(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """A row for each key with the last present value of each field; a partial aggregate, not a window."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields])


def flush_delay(text: Column, started_ms: Column, now_ms: Column, punctuation_ms: int = 320, pause_ms: int = 1200, hold_ms: int = 4200) -> Column:
    """How long a segment waits: shorter after terminal punctuation, never beyond the hold, at least 120 ms, 0 once over it."""
    elapsed = F.greatest(F.lit(0), now_ms - started_ms)
    delay = F.when(text.rlike(r"""[.!?]["')\]]?$"""), punctuation_ms).otherwise(pause_ms)
    return F.when(elapsed >= hold_ms, 0).otherwise(F.greatest(F.lit(120), F.least(delay, F.lit(hold_ms) - elapsed)))
