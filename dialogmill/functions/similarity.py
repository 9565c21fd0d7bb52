"""Similarities of token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmill.functions import text as t


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def speech_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(t.speech(c), " "), lambda x: x != ""))


def overlap(left: Column, right: Column) -> Column:
    """Share of the left text's tokens that the right one has."""
    a, b = t.tokens(left), t.tokens(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def groundedness(answer: Column, context: Column) -> Column:
    """Overlap of the context with the answer; 1 without context."""
    return F.when(t.normalize(context) == "", 1.0).otherwise(overlap(context, answer))


def combine_unique(items: Column, most: int = 7) -> Column:
    """Items whose trimmed lower case wasn't seen before, without empty ones; the first ``most``."""
    def fold(acc: Column, x: Column) -> Column:
        k = F.lower(F.trim(x))
        fresh = (k != "") & ~F.array_contains(acc["keys"], k)
        return F.when(fresh, F.struct(F.array_append(acc["keys"], k).alias("keys"), F.array_append(acc["items"], x).alias("items"))).otherwise(acc)

    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("items"))
    return F.slice(F.aggregate(items, start, fold, lambda a: a["items"]), 1, most)


def clean_tags(tags: Column) -> Column:
    """Tags without blanks around them, each once, without empty ones; null tags stay null."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: t.strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))
