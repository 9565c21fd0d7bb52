"""Pairs of neighbouring rows: question and answer, prior turns, last pairs, runs of one speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.functions import text as t


def qa_pairs(turns: DataFrame, asks: str = "user", answers: str = "assistant") -> DataFrame:
    """conv_id, turn, question, answer, answer_turn: each turn of one role that a turn of the other follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where((F.col("role") == asks) & (F.col("next_role") == answers)).select("conv_id", "turn", "question", "answer", (F.col("turn") + 1).alias("answer_turn"))


def prior_turns(pairs: DataFrame, turns: int = 2, max_chars: int = 420) -> DataFrame:
    """Adds ``prior``: the last ``turns`` pairs of the conversation before this one, as one line."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-turns, -1)
    line = F.concat(F.lit("Q: "), t.normalize(F.col("question")), F.lit(" A: "), t.normalize(F.col("answer")))
    return pairs.withColumn("prior", t.summarize_lines(F.collect_list(line).over(w), max_chars, turns))


def last_pair(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def merge_runs(turns: DataFrame, parts: list[str], order: list[str], speaker: str, text: str = "text") -> DataFrame:
    """Consecutive rows of a speaker as one: parts, run, speaker, first and last order, n and the merged text.

    Gaps and islands by two windows, then one fold over each run; a run's texts meet in one row.
    """
    w = Window.partitionBy(*parts).orderBy(*order)
    starts = F.when(F.lag(speaker).over(w) == F.col(speaker), 0).otherwise(1)
    rows = turns.where(t.strip(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("__new", starts)
    rows = rows.withColumn("run", F.sum("__new").over(w))
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    out = rows.groupBy(*parts, "run", speaker).agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), items.alias("items"))
    return out.withColumn("text", F.aggregate("items", F.lit(""), lambda a, x: t.merge(a, x["__text"]))).drop("items")


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def context_lines(runs: DataFrame, parts: list[str], speaker: str, keep: dict[str, int], max_chars: int = 220) -> DataFrame:
    """The last runs of each speaker, as many as ``keep`` names, in order: parts, run, line."""
    w = Window.partitionBy(*parts, speaker).orderBy(F.col("run").desc())
    most = F.create_map(*[x for k, v in keep.items() for x in (F.lit(k), F.lit(v))])
    rows = runs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.coalesce(F.try_element_at(most, F.col(speaker)), F.lit(0)))
    return rows.select(*parts, "run", F.concat(F.lit("["), F.col(speaker), F.lit("] "), t.clip(F.col("text"), max_chars)).alias("line"))
