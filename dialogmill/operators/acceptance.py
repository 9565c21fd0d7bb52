"""Acceptance in order under rules that look at what was accepted before: the result of a sequential loop, found in parallel rounds.

A page is accepted if no accepted page before it has its url or its token set, none of the last ``window`` accepted ones is similar,
and its host, its category and the whole are below their caps. Each round knows for every undecided page what is accepted before it and what
may yet be. A page that is rejected in every case goes; one that is accepted in every case stays; the others wait. The first undecided
page always has its verdict, so the rounds end, and most pages have theirs in the first few.

Caps that bind are met early: so one task first runs the loop over the first undecided pages of each category, ``TAIL`` in all. It holds as far as no page between
these is left out, unless that one's category or the whole is full by then, and is run again as long as it halves what is undecided. What is accepted before
counts in it as numbers and links. So it also ends the rounds once no more than ``TAIL`` pages are left.

Similar pages: an accepted page is compared with the undecided ones that share a rare token, once, so a group of near copies costs a
link for each member, not for each pair. Whether an undecided page may be similar is first judged by shared tokens alone; only where this
settles too few are the pairs among what is left computed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.operators import scan
from dialogmill.operators.near_dup import matched, prefixes
from dialogmill.operators.state import kept

PAGE = ["pos", "c", "url", "host", "category"]
#: So many undecided pages are a task's work.
TAIL = 4096
#: After every pos.
NEVER = (1 << 63) - 1


def _similar_to(accepted: DataFrame, others: DataFrame, index: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """b (class), a_pos: the classes of ``others`` (c) that are similar to accepted ones (c, pos)."""
    a = index.join(accepted.select(F.col("c").alias("first")), "first", "left_semi")
    b = index.join(others.select(F.col("c").alias("first")), "first", "left_semi")
    return matched(a, b, sets, threshold).join(accepted.select(F.col("c").alias("a"), F.col("pos").alias("a_pos")), "a").select("b", "a_pos")


def _pairs(some: DataFrame, index: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, both ways: the similar ones among the classes (c)."""
    some = index.join(some.select(F.col("c").alias("first")).distinct(), "first", "left_semi")
    one = matched(some, some, sets, threshold, once=True)
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return kept(one.select(F.inline(ways)), "accept-pairs")


def _counted(state: DataFrame, blocks: int) -> DataFrame:
    """Adds for the whole (t), the host (h) and the category (k) how many pages before are accepted (a) and undecided (u)."""
    a, u = F.col("accepted").cast("long"), (~F.col("accepted")).cast("long")
    for name, parts in (("t", []), ("h", ["host"]), ("k", ["category"])):
        state = scan.sums_before(state, parts, ["pos"], {f"{name}a": a, f"{name}u": u}, blocks=blocks)
    return state


def _looped(rows: DataFrame, beyond: int, window: int, max_per_domain: int, max_docs: int) -> DataFrame:
    """pos of the pages that the loop accepts, and, with ``stop``, the first pos that it doesn't settle, if there is one.

    rows: PAGE, quota, ta, ha, ka, whether a page is ``out`` already, links (a_pos, a_ta), rivals (classes), and of the first page of the category that is not
    among the rows: skipped (pos), skipped_ta, skipped_ka. From ``beyond`` on no page is among them.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        places: list[int] = []  # of what is accepted here
        of_class: dict[int, tuple[int, int]] = {}  # class -> (accepted before the loop, in the loop) before its page
        urls, hosts, categories = set(), Counter(), Counter()
        rows = rows.sort_values("pos")
        skipped = sorted((r.skipped, r.skipped_ta, r.skipped_ka, r.quota, str(r.category), r.category) for r in rows.drop_duplicates("category").itertuples() if r.skipped < beyond)[::-1]

        def unsettled(pos: int) -> bool:
            """Whether a page before ``pos`` is left out and might be accepted."""
            while skipped and skipped[-1][0] < pos:
                _, ta, ka, quota, _, category = skipped[-1]
                if ta + len(places) < max_docs and ka + categories[category] < quota:
                    return True
                skipped.pop()
            return False

        for r in rows.itertuples():
            if unsettled(r.pos):
                break
            if r.out or r.url in urls or r.c in of_class or r.ta + len(places) >= max_docs or r.ha + hosts[r.host] >= max_per_domain or r.ka + categories[r.category] >= r.quota:
                continue
            far = [r.ta - x["a_ta"] - 1 + len(places) - bisect_right(places, x["a_pos"]) for x in (r.links if r.links is not None else [])]
            far += [r.ta - of_class[c][0] + len(places) - of_class[c][1] - 1 for c in (r.rivals if r.rivals is not None else []) if c in of_class]
            if any(n < window for n in far):
                continue
            of_class[r.c] = (r.ta, len(places))
            places.append(r.pos)
            urls.add(r.url)
            hosts[r.host] += 1
            categories[r.category] += 1
        stop = [skipped[-1][0]] if unsettled(beyond) else [beyond] if beyond < NEVER else []
        return pd.DataFrame({"pos": pd.Series([*places, *stop], dtype="int64"), "stop": pd.Series([False] * len(places) + [True] * len(stop), dtype="bool")})

    return rows.groupBy().applyInPandas(run, "pos long, stop boolean")


def _loop(counted: DataFrame, sets: DataFrame, index: DataFrame | None, threshold: float, window: int, max_per_domain: int, max_docs: int, left: int, tail: int) -> tuple[DataFrame, DataFrame | None]:
    """(what the loop over the first undecided pages accepts, what is undecided after it or None)."""
    columns = [*PAGE, "quota", scan.BLOCK]
    undecided, accepted = counted.where("NOT accepted"), counted.where("accepted")
    reach = (F.col("ku") < F.greatest(F.lit(max(1, tail // 8)), 8 * F.least("quota", F.lit(1 << 40)))) | F.lit(left <= tail)
    some = kept(undecided.where(reach).orderBy("pos").limit(tail).select(*columns, "ta", "ha", "ka"), "accept-first")
    n, last = some.agg(F.count(F.lit(1)), F.max("pos")).first()
    # a category's pages are left out only after all of its pages here
    skipped = undecided.where(~reach).groupBy(F.col("category").alias("__of")).agg(F.min("pos").alias("skipped"), F.min("ta").alias("skipped_ta"), F.min("ka").alias("skipped_ka"))
    rows = some.join(skipped, F.col("category").eqNullSafe(F.col("__of")), "left").drop("__of").fillna({"skipped": NEVER, "skipped_ta": 0, "skipped_ka": 0})
    if index is None:
        met = some.select("c").unionAll(accepted.select("c")).distinct().withColumnRenamed("c", "first")
        sets = kept(sets.join(met, "first", "left_semi"), "accept-sets")
        index = prefixes(sets, threshold)
    rivals = _pairs(some, index, sets, threshold).groupBy(F.col("a").alias("c")).agg(F.collect_list("b").alias("rivals"))
    near = _similar_to(accepted, some, index, sets, threshold).join(accepted.select(F.col("pos").alias("a_pos"), F.col("ta").alias("a_ta")), "a_pos")
    links = some.select("pos", "c").join(near, F.col("c") == F.col("b")).where("a_pos < pos").groupBy("pos").agg(F.collect_list(F.struct("a_pos", "a_ta")).alias("links"))
    urls, sames = accepted.select("url", F.col("pos").alias("url_a")), accepted.select("c", F.col("pos").alias("c_a"))
    out = F.coalesce(F.col("url_a") < F.col("pos"), F.lit(False)) | F.coalesce(F.col("c_a") < F.col("pos"), F.lit(False))
    rows = rows.join(urls, "url", "left").join(sames, "c", "left").withColumn("out", out).drop("url_a", "c_a").join(rivals, "c", "left").join(links, "pos", "left")
    told = kept(_looped(rows, last + 1 if n == tail else NEVER, window, max_per_domain, max_docs), "accept-loop")
    fresh = kept(some.select(*columns).join(told.where("NOT stop"), "pos", "left_semi"), "accept-fresh")
    stop = told.where("stop").agg(F.min("pos")).first()[0]
    if stop is None:
        return fresh, None
    # all that the loop accepted comes before what it leaves
    still = undecided.where(F.col("pos") >= stop)
    for key, name in (("category", "__k"), ("host", "__h")):
        here = fresh.groupBy(F.col(key).alias("__of")).agg(F.count(F.lit(1)).alias(name))
        still = still.join(here, F.col(key).eqNullSafe(F.col("__of")), "left").drop("__of").fillna({name: 0})
    total = fresh.count()
    still = still.where((F.col("ta") + total < max_docs) & (F.col("ka") + F.col("__k") < F.col("quota")) & (F.col("ha") + F.col("__h") < max_per_domain))
    still = still.join(fresh.select("url"), "url", "left_anti").join(fresh.select("c"), "c", "left_anti")
    return fresh, still.select(*columns)


def accept(pages: DataFrame, quotas: DataFrame, threshold: float = 0.84, window: int = 240, max_per_domain: int = 20, max_docs: int = 900, other_quota: int = 1 << 60, tail: int = TAIL) -> DataFrame:
    """pos and n (how many were accepted before) of the accepted pages.

    pages: pos (the order, without ties), url, host, category, tokens. quotas: category, quota, of a configuration; ``other_quota`` is that of each other category.
    Pages with an empty token set are similar to none, but equal to each other.
    """
    rows = pages.select("pos", "url", "host", "category", F.sort_array("tokens").alias("tokens"))
    rows = kept(rows.withColumn("fp", F.sha1(F.array_join("tokens", " ").cast("binary"))), "accept-pages")
    classes = kept(rows.groupBy("fp").agg(F.min("pos").alias("c"), F.first("tokens").alias("tokens")), "accept-classes")
    sets = classes.where(F.size("tokens") > 0).select(F.col("c").alias("first"), "tokens")
    quota = F.coalesce("quota", F.lit(other_quota))
    state = rows.drop("tokens").join(classes.select("fp", "c"), "fp").join(F.broadcast(quotas.select("category", "quota")), "category", "left").select(*PAGE, quota.alias("quota"))
    state = scan.dealt(state.withColumn("accepted", F.lit(False)), [], ["pos"])
    blocks = state.agg(F.max(scan.BLOCK)).first()[0]
    blocks = 1 if blocks is None else blocks + 1
    index = links = pairs = None
    left = state.count()
    halves = tail > 0
    columns = [*PAGE, "quota", scan.BLOCK]
    while left:
        counted = kept(_counted(state, blocks), "accept-counts")
        if halves or left <= tail:
            fresh, still = _loop(counted, sets, index, threshold, window, max_per_domain, max_docs, left, tail)
            if still is not None and index is not None:
                near = kept(_similar_to(fresh, still, index, sets, threshold), "accept-links")
                links = near if links is None else links.unionByName(near)
            parts = [state.where("accepted").select(*columns, "accepted"), fresh.select(*columns, F.lit(True).alias("accepted"))]
            state = kept(reduce(DataFrame.unionByName, parts + ([] if still is None else [still.withColumn("accepted", F.lit(False))])), "accept-state")
            before, left = left, 0 if still is None else state.where("NOT accepted").count()
            halves = left <= before // 2
            continue
        undecided = counted.where("NOT accepted")
        if index is None:
            index = prefixes(sets, threshold)
            if not counted.where("accepted").isEmpty():
                links = kept(_similar_to(counted.where("accepted"), undecided, index, sets, threshold), "accept-links")
        urls = state.groupBy("url").agg(F.min(F.when(F.col("accepted"), F.col("pos"))).alias("url_a"), F.min(F.when(~F.col("accepted"), F.col("pos"))).alias("url_u"))
        sames = state.groupBy("c").agg(F.min(F.when(F.col("accepted"), F.col("pos"))).alias("c_a"), F.min(F.when(~F.col("accepted"), F.col("pos"))).alias("c_u"))
        waiting = sames.where("c_u IS NOT NULL").select("c", "c_u")
        if pairs is None:
            shared = index.join(waiting, F.col("first") == F.col("c")).groupBy("h").agg(F.min("c_u").alias("earliest"))
            maybe = index.join(waiting.select(F.col("c").alias("first")), "first", "left_semi").join(shared, "h").groupBy(F.col("first").alias("c")).agg(F.min("earliest").alias("rival"))
        else:
            maybe = pairs.join(waiting, F.col("b") == F.col("c")).groupBy(F.col("a").alias("c")).agg(F.min("c_u").alias("rival"))
        rows = undecided.join(urls, "url").join(sames, "c").join(maybe, "c", "left")
        if links is not None:
            # how far back the similar accepted pages are, at least and at most
            marks = counted.where("accepted").select(F.col("pos").alias("a_pos"), F.col("ta").alias("a_ta"), F.col("tu").alias("a_tu"))
            back = undecided.select("pos", "c", "ta", "tu").join(links.join(marks, "a_pos"), F.col("c") == F.col("b")).where("a_pos < pos")
            least = F.col("ta") - F.col("a_ta") - 1
            most = least + F.col("tu") - F.col("a_tu")
            back = back.groupBy(F.col("pos").alias("__p")).agg(F.bool_or(most < window).alias("similar"), F.bool_or(least < window).alias("maybe_similar"))
            rows = rows.join(back, F.col("pos") == F.col("__p"), "left")
        else:
            rows = rows.withColumns({"similar": F.lit(False), "maybe_similar": F.lit(False)})
        by_key = F.coalesce(F.col("url_a") < F.col("pos"), F.lit(False)) | F.coalesce(F.col("c_a") < F.col("pos"), F.lit(False))
        no = F.coalesce("similar", F.lit(False)) | by_key
        no = no | (F.col("ha") >= max_per_domain) | (F.col("ka") >= F.col("quota")) | (F.col("ta") >= max_docs)
        yes = ~F.coalesce("maybe_similar", F.lit(False)) & (F.col("url_u") >= F.col("pos")) & (F.col("c_u") >= F.col("pos")) & (F.coalesce("rival", "pos") >= F.col("pos"))
        yes = yes & (F.col("ha") + F.col("hu") < max_per_domain) & (F.col("ka") + F.col("ku") < F.col("quota")) & (F.col("ta") + F.col("tu") < max_docs)
        verdict = F.when(no, "no").when(yes, "yes").otherwise("?")
        told = kept(rows.select(*PAGE, "quota", scan.BLOCK, verdict.alias("verdict")).where("verdict <> 'no'"), "accept-verdicts")
        fresh = told.where("verdict = 'yes'")
        still = told.where("verdict = '?'")
        before, left = left, still.count()
        if left:
            near = kept(_similar_to(fresh, still, index, sets, threshold), "accept-links")
            links = near if links is None else links.unionByName(near)
            if pairs is None and left > before // 2:
                pairs = _pairs(still, index, sets, threshold)
        state = kept(state.where("accepted").select(*columns, "accepted").unionByName(fresh.select(*columns, F.lit(True).alias("accepted"))).unionByName(still.select(*columns, F.lit(False).alias("accepted"))), "accept-state")
    return scan.sums_before(state.where("accepted").select("pos", scan.BLOCK), [], ["pos"], {"n": F.lit(1)}, blocks=blocks).select("pos", "n")


def similar_accepted(probes: DataFrame, accepted: DataFrame, threshold: float, window: int) -> DataFrame:
    """pos of the probes (pos, tokens, n: pages accepted before) of which one of the last ``window`` accepted pages (pos, n, tokens) is similar."""
    both = probes.select("pos", "n", "tokens", F.lit(False).alias("is_accepted")).unionByName(accepted.select("pos", "n", "tokens", F.lit(True).alias("is_accepted")))
    both = both.where(F.size("tokens") > 0).withColumn("tokens", F.sort_array("tokens")).withColumn("fp", F.sha1(F.array_join("tokens", " ").cast("binary")))
    both = kept(both, "probe-pages")
    # probes with equal sets are one class; accepted pages have different sets and ids of their own
    ids = kept(both.groupBy("fp", "is_accepted").agg((2 * F.min("pos") + F.col("is_accepted").cast("long")).alias("first"), F.first("tokens").alias("tokens")), "probe-classes")
    sets = ids.select("first", "tokens")
    index = prefixes(sets, threshold)
    found = matched(index.where("first % 2 = 1"), index.where("first % 2 = 0"), sets, threshold).select("a", "b")
    a = both.where("is_accepted").select((2 * F.col("pos") + 1).alias("a"), F.col("pos").alias("a_pos"), F.col("n").alias("a_n"))
    b = both.where("NOT is_accepted").join(ids.where("NOT is_accepted").select("fp", F.col("first").alias("b")), "fp").select("b", "pos", "n")
    # place a_n is among the last `window` of n accepted ones
    return found.join(a, "a").join(b, "b").where((F.col("a_pos") < F.col("pos")) & (F.col("a_n") >= F.col("n") - window)).select("pos").distinct()
