"""Training records: building, checking, budgets and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.functions import text as t
from dialogmill.operators.state import kept

# fixed values: records are compared with them
SYSTEM = "You are a live technical interview copilot. Produce a concise, speakable, first-person English answer. Do not ask a question back. Do not mention being an AI. Do not use bullet points or code blocks. Ground the answer in the provided context when available."

QUESTIONS = {"title": ("How would you explain ", " and the main engineering tradeoffs?"), "term": ("How would you explain ", " in a technical interview?")}
NO_TITLE = "How would you explain this engineering concept and its tradeoffs?"


def question_of(kind: str, c: Column) -> Column:
    """The question that a title or a glossary term answers."""
    name = t.normalize(c)
    asked = F.concat(F.lit(QUESTIONS[kind][0]), name, F.lit(QUESTIONS[kind][1]))
    return F.when(name == "", NO_TITLE).otherwise(asked) if kind == "title" else asked


def user_message(question: Column, persona: Column, prior: Column, context: Column) -> Column:
    """Blocks that are present, with an empty line between."""
    lines = F.array_join(F.transform(F.filter(F.transform(context, t.normalize), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    block = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(head + ":\n"), body))
    return F.concat_ws("\n\n", block("Persona Summary", persona), block("Prior Turn Summary", prior), block("Relevant Context Lines", lines), F.concat(F.lit("Latest Interviewer Question:\n"), t.normalize(question)))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft_records(rows: DataFrame) -> DataFrame:
    """rows (question, answer, prior, context, source, bucket, category, quality, rewritten) -> schema_version, messages, metadata."""
    user = user_message(F.col("question"), F.lit(""), F.col("prior"), F.col("context"))
    meta = F.struct(
        F.col("source"), F.col("bucket").alias("source_bucket"), "category", F.lit("speakable_first_person").alias("answer_style"), F.when(F.coalesce("prior", F.lit("")) != "", "multi_turn").otherwise("single_turn").alias("turn_shape"),
        F.when(F.col("bucket") == "session", "pending").otherwise("not_applicable").alias("judge_status"), F.round("quality", 4).alias("quality_score"), F.size("context").alias("context_line_count"),
        t.normalize(F.col("question")).alias("question_text"), F.col("rewritten").alias("rewritten_to_speakable"), t.failure_tags(F.col("answer")).alias("critical_failure_tags"), F.lit("en").alias("imported_language"),
    )
    messages = F.array(message("system", F.lit(SYSTEM)), message("user", user), message("assistant", t.normalize(F.col("answer"))))
    return rows.select(*[c for c in rows.columns if c in ("id", "conv_id", "turn")], F.lit("sft.v2").alias("schema_version"), messages.alias("messages"), meta.alias("metadata"))


def message_fault(messages: Column) -> Column:
    """Why the messages can't be used; null: they can."""
    bad = F.exists(messages, lambda m: m.isNull())
    empty = F.exists(messages, lambda m: (t.strip(F.coalesce(m["role"], F.lit(""))) == "") | (t.strip(F.coalesce(m["content"], F.lit(""))) == ""))
    last = t.strip(F.element_at(messages, -1)["role"])
    return F.when(messages.isNull() | (F.size(messages) < 2), "messages_missing").when(bad, "message_not_object").when(empty, "message_missing_role_or_content").when(last != "assistant", "last_role_not_assistant")


def completion_budget(prompt_tokens: Column, full_tokens: Column, max_length: int) -> Column:
    """Tokens of the completion that truncation leaves."""
    return F.greatest(F.lit(0), F.least(full_tokens, F.lit(max_length)) - F.least(prompt_tokens, F.lit(max_length)))


def gate(metrics: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """Adds blocked_reasons, in order, and blocked to a row of metrics."""
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return metrics.withColumn("blocked_reasons", reasons).withColumn("blocked", F.size("blocked_reasons") > 0)


def prompt_key(messages: Column) -> Column:
    """The last question and the last answer of a record, as a key."""
    last = lambda role: F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))
    return t.key(F.concat(last("user"), F.lit("|"), last("assistant")))


def merge_records(sets: list[DataFrame]) -> DataFrame:
    """Records of the current schema of all sets (schema_version, messages, metadata, ord), the first of each prompt key; adds key and source.

    A partial aggregate keeps the first one, so equal records never meet in a window.
    """
    rows = None
    for n, one in enumerate(sets):
        one = one.where("schema_version = 'sft.v2'").select(F.struct(F.lit(n).alias("set"), "ord").alias("o"), F.struct("messages", "metadata").alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(F.md5(prompt_key(F.col("r.messages")).cast("binary")).alias("key")).agg(F.min("o").alias("o"), F.min_by("r", "o").alias("r"))
    source = F.coalesce(F.nullif("r.metadata.source_bucket", F.lit("")), F.nullif("r.metadata.source", F.lit("")), F.concat(F.lit("set"), F.col("o.set").cast("string")))
    return first.select("key", "o.set", "o.ord", "r.messages", "r.metadata", source.alias("source"))


def judge_merge(rules: DataFrame, external: DataFrame) -> DataFrame:
    """Verdicts of the rules (id, passed, average, failures) with those of another judge (id, passed, average, failures), which count where there are any.

    The other judge's failures count if it names some; the rules' verdict stays as rule_passed.
    """
    theirs = external.select("id", F.col("passed").alias("__p"), F.col("average").alias("__a"), F.col("failures").alias("__f"), F.lit(True).alias("__there"))
    rows = rules.join(theirs, "id", "left")
    there = F.col("__there").isNotNull()
    failures = F.when(there & (F.size(F.coalesce("__f", F.array().cast("array<string>"))) > 0), F.col("__f")).otherwise(F.col("failures"))
    return rows.select("id", F.when(there, "hybrid").otherwise("rules").alias("provider"), F.when(there, F.coalesce("__p", F.lit(False))).otherwise(F.col("passed")).alias("passed"), F.round(F.when(there, F.coalesce("__a", F.lit(0.0))).otherwise(F.col("average")), 4).alias("average"), failures.alias("failures"), F.when(there, F.col("passed")).alias("rule_passed"))


def judged(records: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, reports) of records (id, metadata, ...) by their verdicts; the metadata says which."""
    rows = records.join(verdicts, "id").withColumn("metadata", F.col("metadata").withField("judge_status", F.when(F.col("passed"), "accepted").otherwise("rejected")))
    return rows.where("passed").select(*records.columns), rows.where("NOT passed").select(*records.columns), rows


#: Metrics of a report, whose values count unless they are missing or zero, and what stands for them then.
REPORTED = ["average_quality", "first_person", "speakable", "grounded"]


def qc_metrics(report: DataFrame, recounted: DataFrame) -> DataFrame:
    """One row of metrics: the report's values, and those counted again from the rows where the report has none.

    report: records_train, web_ratio, glossary_ratio, ai_ratio, behavioral_ratio, REPORTED, failure_rate, dropped_duplicates, blocked; recounted: rows,
    REPORTED, failure_rate, near_duplicates. A failure rate of 1 or more counts as none. Dropped duplicates count as near duplicates if they are more.
    """
    own = recounted.select(*[F.col(c).alias(f"__{c}") for c in recounted.columns])
    both = report.join(F.broadcast(own), F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    dropped = F.coalesce("dropped_duplicates", F.lit(0))
    near = F.when((dropped > 0) & (F.col("__rows") > 0), F.greatest(F.col("__near_duplicates"), dropped / (dropped + F.col("__rows")))).otherwise(F.col("__near_duplicates"))
    return both.select(
        F.coalesce(F.nullif("records_train", F.lit(0)), "__rows").alias("rows"), *[zero(F.col(c)).alias(c) for c in ("web_ratio", "glossary_ratio", "ai_ratio", "behavioral_ratio")],
        *[F.coalesce(F.nullif(zero(F.col(c)), F.lit(0.0)), f"__{c}").alias(c) for c in REPORTED],
        F.when(F.coalesce("failure_rate", F.lit(1.0)) >= 1.0, F.col("__failure_rate")).otherwise(F.col("failure_rate")).alias("failure_rate"), near.alias("near_duplicates"), F.coalesce("blocked", F.lit(False)).alias("report_blocked"),
    )


def pooled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(available, dropped) of a build's pools (id, ord, question, answer, hint, fit, category, source, pool, bucket, fault): the rows that stay with their spoken answers and quality, and drop, n: how many aren't, by reason.

    ``fit`` false drops a row, for its ``fault``, as does a spoken answer that isn't fit to be kept; a null category is found from the pair; a quality below the hint is
    raised to it. Of equal pairs of a pool the first by ``ord`` stays. Pairs that are equal as they come are said once, and the aggregates deal them evenly: a small file's rows would be one task's.
    """
    from dialogmill.functions import scoring as sc

    first = lambda *cols: F.min_by(F.struct(*cols), F.struct("ord", "id")).alias("r")
    row = ["id", "ord", "question", "answer", "hint", "category", "source"]
    kind = ["pool", "bucket", "fault"]
    rows = rows.withColumn("question", t.normalize(F.col("question")))
    rows = rows.withColumn("fit", F.coalesce("fit", F.lit(True)) & (F.col("question") != ""))
    pair = F.concat_ws("|", F.md5(F.col("question").cast("binary")), F.md5(F.coalesce("answer", F.lit("")).cast("binary")))
    # rows that aren't fit are only counted
    rows = rows.select(*kind, "fit", *[F.when(F.col("fit"), F.col(c)).alias(c) if c == "answer" else c for c in row], F.when(F.col("fit"), pair).alias("pair"))
    said = rows.groupBy(*kind, "fit", "pair").agg(F.count(F.lit(1)).alias("n"), first(*row)).select(*kind, "fit", "n", "r.*")
    said = said.withColumn("answer", t.speakable(F.col("answer"), F.col("question"))["text"])
    said = said.withColumns({"fit": F.col("fit") & sc.keep_answer(F.col("answer")), "sign": F.md5(t.key(F.concat_ws("|", "pool", "question", "answer")).cast("binary"))})
    said = kept(said, "build-spoken")  # else every use below would say it anew
    left = said.where("fit").groupBy("sign").agg((F.sum("n") - 1).alias("copies"), first("bucket", *row)).select("copies", "r.*")
    quality = F.greatest(F.coalesce("hint", F.lit(0.0)), sc.answer_hundredths(F.col("answer"), F.col("question")) / 100.0)
    category = F.coalesce(F.nullif(t.normalize(F.col("category")), F.lit("")), sc.classify(F.col("question"), F.col("answer")))
    left = kept(left.select("id", "bucket", "source", category.alias("category"), F.round(quality, 4).alias("quality"), "question", "answer", "copies"), "build-available")
    dropped = said.where("NOT fit").groupBy(F.col("fault").alias("drop")).agg(F.sum("n").alias("n")).unionByName(left.select(F.lit("duplicate").alias("drop"), F.col("copies").alias("n")).groupBy("drop").agg(F.sum("n").alias("n")).where("n > 0"))
    return left.drop("copies"), dropped


def build_counters(rows: DataFrame, dropped: DataFrame, final: DataFrame) -> DataFrame:
    """counter, name, n: available rows by bucket, source and category, dropped ones (drop, n) by reason, and those of the final mix. Each table is read once."""
    def counts(rows: DataFrame, label: str) -> DataFrame:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(f"{label}_{c}").alias("counter"), F.col(c).alias("name")) for c in ("bucket", "source", "category")])).alias("x"))
        return long.groupBy("x.counter", "x.name").agg(F.count(F.lit(1)).alias("n"))

    out = dropped.select(F.lit("dropped").alias("counter"), F.col("drop").alias("name"), "n")
    return out.unionByName(counts(rows, "raw")).unionByName(counts(final, "final"))
