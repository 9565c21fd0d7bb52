"""Mixing sources to target weights, in built-in functions only.

A source of token share p gets the weight p**a / sum(p**a). The exponent a in [0, 1] is bisected:
the smallest one, hence the most even mix, whose sources are repeated no more than ``max_repeats``
times, or the largest one whose mix has at least ``min_entropy`` nats. The weights are realised as
blocks: each block of a source is one permutation of all its documents, and the last block is the
prefix of its permutation that fits what is left of the source's token budget.

Tokens are words. The default total budget gives the source with the fewest passes exactly one
pass, so no document is lost.

Nulls: a null text has no tokens; null sources are one source of their own; null ids are ordered
like the empty string. A source without tokens has weight 0 and passes once. Repeated rows share a
place in the permutation and enter or stay out together. An empty table gives an empty result.
Extra columns stay with their row; one named like an added column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.llm.common import WORD, materialize, table

#: Bits of the bisected exponent.
STEPS = 20
#: Up to so many sources the budgets are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000
BUCKET_DIGITS = 4


def place(seed: str, block: Column, doc_id: Column) -> Column:
    """Where a document stands in the permutation of a block."""
    return F.md5(F.concat_ws("|", F.lit(seed), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_tokens(docs: DataFrame) -> DataFrame:
    """source, n_docs, tokens."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("source", tokens.alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("tokens"))


def bisect_exponent(sources: DataFrame, max_repeats: float | None, min_entropy: float | None) -> tuple[float, float]:
    """(exponent, total budget). Every step is one aggregate over the sources, which may be many."""
    some = sources.where("tokens > 0")
    total, most, least = some.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not total:
        return 1.0, 0.0
    share = F.col("tokens") / F.lit(float(total))

    def fits(a: float) -> bool:
        weight = F.pow(share, F.lit(a))
        if max_repeats is not None:
            # passes are proportional to share ** (a - 1), and the largest source makes one
            worst = some.agg(F.max(F.pow(share, F.lit(a - 1.0))) / F.min(F.pow(share, F.lit(a - 1.0)))).first()[0]
            return worst <= max_repeats
        z, zl = some.agg(F.sum(weight), F.sum(weight * F.ln(weight))).first()
        return not math.log(z) - zl / z >= min_entropy

    if max_repeats is None and min_entropy is None or most == least:
        exponent = 1.0
    else:
        low, high = 0, 1 << STEPS  # fits() holds at high, or nothing but the plain shares is left
        if fits(0.0):
            high = 0
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(mid / (1 << STEPS)) else (mid, high)
        exponent = (high if max_repeats is not None else low) / (1 << STEPS)
    top = (most / total) ** exponent
    z = some.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0]
    return exponent, most * z / top


def most_tokens(sources: DataFrame) -> int:
    return sources.agg(F.max("tokens")).first()[0] or 0


def source_budgets(sources: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """source, n_docs, tokens, weight, budget (tokens), full (whole blocks), rest (tokens of the last block)."""
    exponent, budget = bisect_exponent(sources, max_repeats, min_entropy)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    out = sources.withColumn("weight", power / F.lit(float(z)))
    # a hair is added, so that the source that makes one whole pass isn't rounded below it
    budget_of = F.floor(F.col("weight") * F.lit(float(budget_tokens or budget)) + F.lit(1e-6)).cast("long")
    # of the largest source at scale the hair is less than the rounding: by default no source is cut below a whole pass
    out = out.withColumn("budget", budget_of if budget_tokens else F.when(F.col("tokens") == F.lit(most_tokens(sources)), F.greatest(budget_of, F.col("tokens"))).otherwise(budget_of))
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("long")
    return out.withColumn("full", full).withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).cast("long"))


def with_budgets(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    right = budgets.select(F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in budgets.columns if c != "source"])
    if right.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return docs.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def cutoffs(docs: DataFrame, budgets: DataFrame, seed: str) -> DataFrame:
    """For each source the last place of its permutation that the last block takes; null: none.

    Sums by (source, first digits of the place) find the digits where the budget ends; only the
    rows with these digits are then looked at one by one, so no task sees a whole source.
    """
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    narrow = with_budgets(docs.select("source", "doc_id", tokens.alias("n")), budgets.select("source", "full", "rest"))
    narrow = narrow.where("__rest > 0").select("source", "n", F.col("__rest").alias("rest"), place(seed, F.col("__full"), F.col("doc_id")).alias("u"))
    narrow = materialize(narrow.withColumn("b", F.substring("u", 1, BUCKET_DIGITS)), "mix-places")
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = narrow.groupBy("source", "b", "rest").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(run))
    sums = materialize(sums.select("source", "b", "rest", (F.col("upto") - F.col("n")).alias("before"), "upto"), "mix-sums")
    whole = sums.where("upto <= rest").groupBy("source").agg(F.max("b").alias("b"))
    edge = sums.where("before <= rest AND upto > rest").select(F.col("source").alias("__s"), F.col("b").alias("__b"), "before")
    inside = narrow.join(edge, F.col("source").eqNullSafe(F.col("__s")) & (F.col("b") == F.col("__b")))
    inside = inside.groupBy("source", "b", "before", "rest", "u").agg(F.sum("n").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source", "b").orderBy("u"))
    inside = inside.withColumn("upto", upto).where("upto <= rest").groupBy("source").agg(F.max("u").alias("u"))
    # all places with the digits b are below b + 'g', and '0'-'f' sort before 'g'
    return inside.select("source", "u").unionByName(whole.select("source", F.concat("b", F.lit("g")).alias("u"))).groupBy("source").agg(F.max("u").alias("cut"))


def mix(docs: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None, budget_tokens: int | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with one row for each time a document is used.

    Added: ``block`` (from 0), ``weight`` of its source and ``mix_place`` (its place in the block's
    permutation; sorting by (block, mix_place) interleaves the sources).
    """
    docs = docs.drop("block", "weight", "mix_place")
    budgets = materialize(source_budgets(materialize(source_tokens(docs), "mix-sources"), max_repeats, min_entropy, budget_tokens), "mix-budgets")
    cut = cutoffs(docs, budgets, seed)
    right = budgets.join(cut.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "weight", "full", "cut")
    out = with_budgets(docs, materialize(right, "mix-plan"))
    taken = F.col("__cut").isNotNull() & (place(seed, F.col("__full"), F.col("doc_id")) <= F.col("__cut"))
    copies = F.col("__full") + taken.cast("long")
    out = out.withColumn("block", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))))
    return out.select(*docs.columns, "block", F.col("__weight").alias("weight"), place(seed, F.col("block"), F.col("doc_id")).alias("mix_place"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return out.select("doc_id", "source", tokens.alias("n_tokens"), "block", F.round("weight", 6).alias("weight"), "mix_place")


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens)::DOUBLE AS total, max(tokens)::DOUBLE AS most, min(tokens) FILTER (tokens > 0)::DOUBLE AS least FROM s),
x AS (SELECT 0 AS low, CASE WHEN most / least <= 2 THEN 0 ELSE 1048576 END AS high FROM t
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END
  FROM (SELECT low, high, mid, pow(least / total, mid / 1048576.0::DOUBLE - 1) / pow(most / total, mid / 1048576.0::DOUBLE - 1) <= 2 AS ok
        FROM (SELECT low, high, (low + high) // 2 AS mid FROM x WHERE high - low > 1), t)),
a AS (SELECT CASE WHEN most = least THEN 1.0::DOUBLE ELSE min(high) / 1048576.0::DOUBLE END AS e FROM x, t GROUP BY most, least),
p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / total, e) ELSE 0 END AS power FROM s, t, a),
w AS (SELECT source, tokens, power / (SELECT sum(power) FROM p) AS weight FROM p),
g AS (SELECT source, tokens, weight, floor(weight * (SELECT most * (SELECT sum(power) FROM p) / pow(most / total, e) FROM t, a) + 1e-6)::BIGINT AS budget FROM w),
f AS (SELECT source, weight, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS n_full, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM g),
u AS (SELECT d.*, weight, n_full, rest, md5('mix|' || n_full || '|' || coalesce(doc_id::VARCHAR, '')) AS u FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
c AS (SELECT *, n_full + (rest > 0 AND sum(n_tokens) OVER (PARTITION BY source ORDER BY u) <= rest)::BIGINT AS copies FROM u),
b AS (SELECT doc_id, source, n_tokens, weight, unnest(range(copies)) AS block FROM c)
SELECT doc_id, source, n_tokens, block::BIGINT AS block, round(weight, 6) AS weight, md5('mix|' || block || '|' || coalesce(doc_id::VARCHAR, '')) AS mix_place FROM b
"""
