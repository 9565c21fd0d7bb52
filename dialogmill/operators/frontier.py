"""Breadth-first levels of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.operators.state import kept


def frontier(seeds: DataFrame, links: DataFrame, depth: int, per_page: int = 18) -> DataFrame:
    """category, url, depth, via: what each category's seeds (category, url) reach over links (src, rank, link) in ``depth`` steps.

    Of a page's links the first ``per_page`` (rank from 1) count. A url belongs to the first level that finds it in its category; via is the smallest
    of that level's pages that link to it, null for seeds. Each level is written, so that none is computed again by the next ones, and is
    the only one that meets the links; what was found before goes by an anti join.
    """
    first = links.where(F.col("rank") <= per_page).select("src", "link").distinct()
    level = kept(seeds.select("category", "url").distinct().withColumns({"depth": F.lit(0), "via": F.lit(None).cast("string")}), "crawl-level")
    found = level
    for d in range(1, depth + 1):
        met = level.select("category", F.col("url").alias("src")).join(first, "src").groupBy("category", F.col("link").alias("url")).agg(F.min("src").alias("via"))
        seen = found.select(F.col("category").alias("__c"), F.col("url").alias("__u"))
        met = met.join(seen, F.col("category").eqNullSafe(F.col("__c")) & (F.col("url") == F.col("__u")), "left_anti")
        level = kept(met.select("category", "url", F.lit(d).alias("depth"), "via"), "crawl-level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found
