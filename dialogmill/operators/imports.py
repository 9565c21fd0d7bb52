"""Question-answer pairs out of other collections: transcripts with role marks, message trees, dialogues in one text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.functions import scoring as sc
from dialogmill.functions import text as t
from dialogmill.operators.pairs import keep_first
from dialogmill.operators.state import kept

# fixed values: the role marks of transcripts and of dialogues, as patterns
TURN = r"(?ms)^\s*(Assistant|AI|User):\s*(.*?)(?=^\s*(?:Assistant|AI|User):|\z)"
EXCHANGE = r"(?s)\n\nHuman:\s*(.*?)\n\nAssistant:\s*(.*?)(?=\n\nHuman:|\z)"


def transcript_pairs(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds place, question and answer: each turn of the interviewer (Assistant, AI) that a turn of the user follows."""
    found = lambda g: F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TURN), F.lit(g))
    rows = rows.withColumn("__roles", found(1)).withColumn("__said", found(2))
    asks = F.filter(F.sequence(F.lit(0), F.size("__roles")), lambda i: F.get("__roles", i).isin("Assistant", "AI") & (F.get("__roles", i + 1) == "User"))
    rows = rows.withColumn("place", F.explode(asks))
    said = lambda i: t.normalize(F.get("__said", i))
    return rows.withColumn("question", said(F.col("place"))).withColumn("answer", said(F.col("place") + 1)).drop("__roles", "__said")


def last_exchange(c: Column) -> Column:
    """struct(question, answer) of the last exchange of a dialogue; null without one."""
    group = lambda x, g: t.normalize(F.regexp_extract(F.element_at(x, -1), EXCHANGE, g))
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EXCHANGE), F.lit(0))
    return t.let(found, lambda x: F.when(F.size(x) > 0, F.struct(group(x, 1).alias("question"), group(x, 2).alias("answer"))))


def tree_pairs(messages: DataFrame) -> DataFrame:
    """message_id, parent_id, lang, question, answer: answers that stand, in a known language, with the question they name as their parent.

    messages: message_id, parent_id, role, text, lang, deleted, review_result, ord. Of messages with one id the last is the parent.
    """
    parents = messages.where("message_id <> ''").groupBy("message_id").agg(F.max_by(F.struct("role", "text"), "ord").alias("p")).select(F.col("message_id").alias("parent_id"), "p").where("p.role = 'prompter'")
    answers = messages.where("role = 'assistant' AND NOT coalesce(deleted, false) AND coalesce(review_result, true) AND lang IN ('en', 'tr')")
    return answers.join(parents, "parent_id").select("ord", "message_id", "parent_id", "lang", F.coalesce("p.text", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("answer"))


def import_rows(pairs: DataFrame, source: str, language: Column | str = "en", least: int = 35, most: int = 320) -> DataFrame:
    """Pairs (question, answer, ...) that are kept, as rows of the importer: id, question, reply_en, reply_tr, source, category, language, quality_score and the pair's other columns."""
    language = F.lit(language) if isinstance(language, str) else language
    # a generator's columns are computed once, while a filter would compute a pair anew for each of its tests
    pairs = pairs.select(*[c for c in pairs.columns if c not in ("question", "answer")], F.inline(F.array(F.struct("question", "answer"))))
    rows = pairs.where(sc.keep_import(F.col("question"), F.col("answer"), max(10, least), max(40, most))).withColumn("language", language)
    rows = rows.withColumn("category", sc.classify_import(F.col("question"), F.col("answer"))).withColumn("quality_score", sc.import_quality(F.col("question"), F.col("answer"), F.col("category")))
    reply = lambda lang: t.normalize(F.when(F.col("language") == lang, F.col("answer")).otherwise(""))
    rows = rows.withColumns({"reply_en": F.when(F.col("language") == "tr", "").otherwise(t.normalize(F.col("answer"))), "reply_tr": reply("tr"), "question": t.normalize(F.col("question")), "source": F.lit(source)})
    ident = F.substring(F.sha1(F.concat_ws("|", "source", "question", "reply_en", "reply_tr").cast("binary")), 1, 16)
    others = [c for c in pairs.columns if c not in ("question", "answer")]
    return rows.select(ident.alias("id"), "question", "reply_en", "reply_tr", "source", "category", "language", "quality_score", *others)


def import_all(sources: list[DataFrame], most: int = 2500) -> DataFrame:
    """The sources one after another: rows whose question and English reply weren't imported before, in the order of ``ord``, ``most`` of each.

    A row beyond its source's cap was never imported, so it doesn't keep out a later source's.
    """
    key = F.sha1(F.concat_ws("|", t.normalize(F.col("question")), t.normalize(F.col("reply_en"))).cast("binary"))
    done: list[DataFrame] = []
    for rows in sources:
        rows = keep_first(kept(rows, "import").withColumn("__key", key), ["__key"], ["ord"])
        for seen in done:
            rows = rows.join(seen.select("__key"), "__key", "left_anti")
        done.append(kept(rows.orderBy("ord").limit(most), "imported"))
    return reduce(DataFrame.unionByName, done).drop("__key")


def import_counters(rows: DataFrame) -> DataFrame:
    """counter, name, n: imported rows by source, category and language."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(c, F.lit("unknown")).alias("name")) for c in ("source", "category", "language")])).alias("x"))
    return long.groupBy("x.counter", "x.name").agg(F.count(F.lit(1)).alias("n"))
