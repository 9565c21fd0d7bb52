"""Quotas and source mixes in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_quotas(specs: DataFrame, max_docs: int, cap: int) -> DataFrame:
    """category, quota: shares by weight with largest remainders, under a cap, then one more by weight.

    The table has a row for each category of a configuration, so one window over all of it is small.
    """
    every = Window.partitionBy(F.lit(0))
    raw = F.lit(max_docs) * (F.col("weight") / F.sum(F.greatest(F.lit(0.05), F.col("weight"))).over(every))
    rows = specs.withColumn("raw", raw).withColumn("quota", F.least(F.lit(cap), F.floor("raw")).cast("long"))
    for order in (F.col("raw") - F.floor("raw"), F.col("weight")):
        place = F.row_number().over(every.orderBy(F.col("quota") >= cap, order.desc(), "category"))
        rows = rows.withColumn("k", place).withColumn("left", F.lit(max_docs) - F.sum("quota").over(every))
        rows = rows.withColumn("quota", F.col("quota") + ((F.col("quota") < cap) & (F.col("k") <= F.col("left"))).cast("long"))
    return rows.select("category", "quota")


def even_quotas(specs: DataFrame, max_docs: int, cap: int) -> DataFrame:
    """category, quota: the same for each category, at least one, under a cap; what is over or missing goes from or to the first ones, one each.

    The table has a row for each category of a configuration, numbered from 0 in its order.
    """
    every = Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(every)
    base = F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(F.lit(max_docs) / n))).cast("long")
    left = F.lit(max_docs) - base * n
    place = F.row_number().over(every.orderBy("category"))
    one = F.when((left > 0) & (place <= left) & (base < cap), 1).when((left < 0) & (place <= -left) & (base > 0), -1).otherwise(0)
    return specs.select("category", (base + one).cast("long").alias("quota"))


def take_counts(web: int, session: int, glossary: int, r_web: float, r_session: float, r_glossary: float) -> dict[str, int]:
    """Rows to take of each pool so that the ratios hold: web and session at least, glossary at most.

    A share r of a total of T rows fits a pool of n rows if r * T <= n. The largest T that fits web, session and, with what is not
    glossary, both is taken; then session takes what web's least share leaves, web what session leaves, glossary the rest under its share.
    """
    r_web, r_session, r_glossary = (min(1.0, max(0.0, r)) for r in (r_web, r_session, r_glossary))
    everything = web + session + glossary
    shares = [(web, r_web), (session, r_session), (web + session, 1 - r_glossary)]
    total = min([everything, *(int(n / max(1e-9, r)) for n, r in shares if n and r > 0)]) or everything
    least_web, least_session = min(web, math.ceil(r_web * total)), min(session, math.ceil(r_session * total))
    take_session = min(session, max(least_session, total - least_web))
    take_web = min(web, max(least_web, total - take_session))
    take_glossary = min(glossary, math.floor(r_glossary * total), max(0, total - take_web - take_session))
    return {"web_corpus": take_web, "session": take_session, "glossary": take_glossary}


def shuffle_key(seed: str, key: Column) -> Column:
    """A place in a shuffle that depends on the row alone."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))


def source_mix(pool: DataFrame, bucket: str, key: str, r_web: float, r_session: float, r_glossary: float, seed: str = "mix") -> DataFrame:
    """The rows of the pool that the mix takes, the first ones of each bucket's shuffle.

    A count of each bucket goes to the driver. A bucket's cut-off is found by ordered limits, not by
    ranking the bucket in one window, so that no task holds a whole bucket.
    """
    sizes = {r[bucket]: r["n"] for r in pool.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()}
    take = take_counts(sizes.get("web_corpus", 0), sizes.get("session", 0), sizes.get("glossary", 0), r_web, r_session, r_glossary)
    rows = pool.withColumn("__u", shuffle_key(seed, F.col(key)))
    keep = F.lit(False)
    for name, n in take.items():
        if n >= sizes.get(name, 0):
            keep = keep | (F.col(bucket) == name)
        elif n > 0:
            cut = kth_smallest(rows.where(F.col(bucket) == name), "__u", n)
            keep = keep | ((F.col(bucket) == name) & (F.col("__u") <= cut))
    return rows.where(keep).drop("__u")


def kth_smallest(rows: DataFrame, hex_column: str, k: int) -> str | None:
    """The k-th smallest of distinct hex strings: counts by leading digits, then the digits of one group."""
    prefix = ""
    while True:
        at = len(prefix)
        here = rows if not prefix else rows.where(F.col(hex_column).startswith(prefix))
        groups = here.groupBy(F.substring(hex_column, at + 1, 2).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(hex_column).alias("one")).orderBy("d").collect()
        for g in groups:
            if k <= g["n"]:
                if g["n"] == 1 or at + 2 >= 32:
                    return g["one"]
                prefix += g["d"]
                break
            k -= g["n"]
        else:
            return None
        if g["n"] <= 10_000:
            return rows.where(F.col(hex_column).startswith(prefix)).select(hex_column).orderBy(hex_column).limit(k).collect()[-1][0]


def train_valid_split(rows: DataFrame, key: str, ratio: float, seed: str = "split") -> DataFrame:
    """Adds ``split``: the first max(1, n * ratio) rows of a shuffle are valid; of one row none is."""
    ratio = min(max(ratio, 0.0), 0.4)
    n = rows.count()
    if n <= 1:
        return rows.withColumn("split", F.lit("train"))
    rows = rows.withColumn("__u", shuffle_key(seed, F.col(key)))
    cut = kth_smallest(rows, "__u", max(1, int(n * ratio)))
    return rows.withColumn("split", F.when(F.col("__u") <= cut, "valid").otherwise("train")).drop("__u")
