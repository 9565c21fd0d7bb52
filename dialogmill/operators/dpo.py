"""Preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.functions import text as t

CONFIDENCE = {"legacy": 0.8, "reviewed_session_pair": 0.95, "reviewed_plus_sampled": 0.88, "sampled_repair_pair": 0.84}


def legacy_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """key, chosen, rejected: each chosen row (key, answer, pos) with the first rejected one of its key, if it differs."""
    first = rejected.groupBy("key").agg(F.min_by("answer", "pos").alias("rejected"))
    out = chosen.join(first, "key").where("answer <> '' AND rejected <> '' AND answer <> rejected")
    return out.select("key", "pos", F.col("answer").alias("chosen"), "rejected", F.lit(CONFIDENCE["legacy"]).alias("confidence"))


def session_pairs(reviewed: DataFrame, sampled: DataFrame) -> DataFrame:
    """Pairs of both directions: a chosen answer with the first rejected one of its key that differs, else with the first such
    sample; and a rejected answer with the first chosen one that differs, else with a sample as its repair. Equal pairs count once, the first direction first.

    reviewed: key, answer, label (chosen, rejected or else), tags, pos; sampled: key, completion, pos. Blank answers are left out. An answer
    differs from all answers of its key but one, so the first two different answers of each key hold the wanted one: rows
    are joined with these two, not with all answers of the key.
    """
    answers = reviewed.select("key", t.strip(F.col("answer")).alias("text"), "label", "tags", "pos").where("text <> ''").withColumn("k", t.key(F.col("text")))
    samples = sampled.select("key", t.strip(F.col("completion")).alias("text"), F.array().cast("array<string>").alias("tags"), "pos").where("text <> ''").withColumn("k", t.key(F.col("text")))

    def firsts(rows: DataFrame, name: str) -> DataFrame:
        one = rows.groupBy("key", "k").agg(F.min(F.struct("pos", "text", "tags")).alias("x")).select("key", F.struct("x.pos", "k", "x.text", "x.tags").alias("x"))
        w = Window.partitionBy("key").orderBy("x.pos")
        one = one.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
        return one.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias(name))

    def other(name: str) -> Column:
        return F.try_element_at(F.filter(F.coalesce(F.col(name), F.array().cast("array<struct<pos:bigint,k:string,text:string,tags:array<string>>>")), lambda x: x["k"] != F.col("k")), F.lit(1))

    made = firsts(samples, "made")

    def paired(own: str, wanted: str, sampled_as: str, direction: int) -> DataFrame:
        rows = answers.where(F.col("label") == own).join(firsts(answers.where(F.col("label") == wanted), "theirs"), "key", "left").join(made, "key", "left")
        rows = rows.select("key", "pos", "k", "text", "tags", other("theirs").alias("a"), other("made").alias("b"))
        rows = rows.withColumn("found", F.coalesce("a", "b")).where("found IS NOT NULL").withColumn("source", F.when(F.col("a").isNotNull(), "reviewed_session_pair").otherwise(sampled_as))
        good, bad = (("text", "k"), ("found.text", "found.k")) if own == "chosen" else (("found.text", "found.k"), ("text", "k"))
        tags = F.col("a.tags") if own == "chosen" else F.col("tags")
        tags = F.when(F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0, tags).otherwise(t.failure_tags(F.col(bad[0])))
        return rows.select("key", F.lit(direction).alias("direction"), "pos", F.col(good[0]).alias("chosen"), F.col(bad[0]).alias("rejected"), "source", tags.alias("reason_tags"), F.col(good[1]).alias("gk"), F.col(bad[1]).alias("bk"))

    both = paired("chosen", "rejected", "reviewed_plus_sampled", 0).unionByName(paired("rejected", "chosen", "sampled_repair_pair", 1))
    first = both.groupBy("key", "gk", "bk").agg(F.min(F.struct("direction", "pos", "chosen", "rejected", "source", "reason_tags")).alias("x")).select("key", "x.*")
    confidence = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    return first.withColumn("confidence", F.element_at(confidence, F.col("source")))


def pair_report(legacy: DataFrame, session: DataFrame, chosen: DataFrame, rejected: DataFrame, reviewed: DataFrame, sampled: DataFrame) -> DataFrame:
    """name, n: what went in and what came out, one row a number."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    out = count(chosen, "chosen_rows")
    for df, name in (
        (rejected, "rejected_rows"), (reviewed.where("label IN ('chosen', 'rejected')").where(t.strip(F.col("answer")) != "").select("key").distinct(), "reviewed_session_prompts"),
        (sampled.where(t.strip(F.col("completion")) != "").select("key").distinct(), "sampled_prompt_keys"), (legacy, "legacy_pairs"), (session, "session_pairs"), (legacy.select("key").unionAll(session.select("key")), "pairs"),
    ):
        out = out.unionAll(count(df, name))
    return out
