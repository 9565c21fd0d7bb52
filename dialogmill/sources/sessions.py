"""Session exports: scans, candidates, the store, exports and the worker protocol."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.functions import text as t
from dialogmill.sources import schemas
from dialogmill.sources.jsonl import read_json, read_jsonl


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session files with an id, with their names; version 1 is read like version 2."""
    return read_json(spark, path, schemas.SESSION).withColumn("file", F.col("_metadata.file_name")).where("id IS NOT NULL")


def reviewed_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_sessions(spark, path).where("assists IS NOT NULL")


def prebuilt_candidates(spark: SparkSession, path: str) -> DataFrame:
    """sft.v2 records with messages and metadata, in the session bucket."""
    rows = read_jsonl(spark, path, schemas.SFT).where("schema_version = 'sft.v2' AND messages IS NOT NULL AND metadata IS NOT NULL")
    return rows.withColumn("metadata", F.col("metadata").withField("source_bucket", F.lit("session")))


def transcripts(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("id").alias("session_id"), F.posexplode("transcripts").alias("pos", "x")).select("session_id", "pos", "x.*")


def assists(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("id").alias("session_id"), F.posexplode("assists").alias("pos", "x")).select("session_id", "pos", "x.*")


def assist_questions(sessions: DataFrame) -> DataFrame:
    """session_id, pos, question, answer of final assists: their own text, else that of their transcript, whose last duplicate counts."""
    last = transcripts(sessions).groupBy("session_id", F.col("id").alias("transcriptId")).agg(F.max_by("text", "pos").alias("heard"))
    rows = assists(sessions).where("state = 'final'").join(last, ["session_id", "transcriptId"], "left")
    others = [c for c in rows.columns if c not in ("session_id", "pos", "transcriptId", "sourceText", "answerEn", "heard")]
    return rows.select("session_id", "pos", F.coalesce(F.nullif(t.strip(F.col("sourceText")), F.lit("")), "heard").alias("question"), F.col("answerEn").alias("answer"), *others)


def session_candidates(sessions: DataFrame) -> DataFrame:
    """Question-answer candidates of a session: spoken form, fit answers, the first of equal pairs, with prior turns."""
    from dialogmill.functions import scoring as sc
    from dialogmill.operators.pairs import keep_first, prior_turns

    rows = assist_questions(sessions).withColumn("s", t.speakable(F.col("answer"), F.col("question")))
    rows = rows.select(F.col("session_id").alias("conv_id"), F.col("pos").alias("turn"), "question", F.col("s.text").alias("answer"), F.col("s.rewritten").alias("rewritten"))
    rows = rows.where(sc.keep_answer(F.col("answer")))
    rows = keep_first(rows, [F.concat_ws("|", t.key(F.col("question")), t.key(F.col("answer")))], ["conv_id", "turn"])
    return prior_turns(rows)


def save_sessions(sessions: DataFrame, path: str) -> None:
    """Upserts by id: files of the sessions at hand are replaced, others stay."""
    sessions.withColumn("session", F.col("id")).write.partitionBy("session").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_sessions(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Stored sessions, all or some by their ids, which read these ones' files only."""
    rows = spark.read.parquet(path)
    return (rows if ids is None else rows.where(F.col("session").isin(ids))).drop("session")


def broken_sessions(spark: SparkSession, path: str) -> DataFrame:
    """file of each session file that is no JSON object."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    parsed = F.from_json("value", "id STRING, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    return rows.where(parsed.isNull() | parsed["_corrupt"].isNotNull() | ~F.ltrim("value").startswith("{")).select("file")


def normalized(sessions: DataFrame) -> DataFrame:
    """Sessions of the current version: missing labels are unreviewed, tags are trimmed and distinct, blank comments are none."""
    from dialogmill.functions.similarity import clean_tags

    def assist(x: Column) -> Column:
        return x.withField("reviewLabel", F.coalesce(F.nullif(x["reviewLabel"], F.lit("")), F.lit("unreviewed"))).withField("reviewTags", clean_tags(x["reviewTags"])).withField("reviewComment", F.nullif(t.strip(x["reviewComment"]), F.lit("")))

    rows = sessions.withColumn("schemaVersion", F.lit("session.v2"))
    return rows.withColumn("assists", F.transform(F.coalesce("assists", F.expr("filter(assists, x -> false)")), assist))


def review_counts(assists: Column) -> Column:
    """struct of reviewed, chosen and rejected assists; skipped ones aren't reviewed."""
    own = F.coalesce(assists, F.array())
    n = lambda test: F.size(F.filter(own, test))
    label = lambda x: F.coalesce(x["reviewLabel"], F.lit(""))
    return F.struct(n(lambda x: ~label(x).isin("", "unreviewed", "skipped")).alias("reviewed"), n(lambda x: label(x) == "chosen").alias("chosen"), n(lambda x: label(x) == "rejected").alias("rejected"))


def session_list(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """id, started, ended, counts of transcripts, assists and reviews; the latest first."""
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    rows = sessions.withColumn("__r", review_counts(F.col("assists"))).select("id", "startedAtMs", "endedAtMs", size("transcripts").alias("transcripts"), size("assists").alias("assists"), "__r.*")
    rows = rows.orderBy(F.col("startedAtMs").desc(), "id")
    return rows if limit is None else rows.limit(limit)


def snapshots(transcripts: DataFrame, assists: DataFrame, sessions: DataFrame) -> DataFrame:
    """Finished sessions (id, startedAtMs, endedAtMs) with their transcripts (session_id, ord, ...) and assists (session_id, transcriptId, ord, state, ...) as arrays.

    Partial assists are left out; of those of one transcript the fields of the last one that has them count, at the place of the first. Sessions with neither go.
    """
    own = [c for c in assists.columns if c not in ("session_id", "ord", "transcriptId")]
    last = assists.where("state <> 'partial'").groupBy("session_id", "transcriptId").agg(F.min("ord").alias("ord"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in own])

    def listed(rows: DataFrame, name: str) -> DataFrame:
        items = F.struct("ord", F.struct(*[c for c in rows.columns if c not in ("session_id", "ord")]).alias("x"))
        return rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(items)), lambda i: i["x"]).alias(name)).withColumnRenamed("session_id", "id")

    rows = sessions.join(listed(transcripts, "transcripts"), "id", "left").join(listed(last, "assists"), "id", "left")
    return rows.where("transcripts IS NOT NULL OR assists IS NOT NULL").withColumn("schemaVersion", F.lit("session.v2"))


def iso(ms: Column) -> Column:
    """Milliseconds since the epoch as a time in UTC; a dash without any."""
    at = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("-"))


def _table_of(items: Column, columns: list[str], line: Callable[[Column], list[Column]]) -> Column:
    """A Markdown table with a line for each item; one of dashes without items."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    body = F.array_join(F.transform(F.coalesce(items, F.filter(items, lambda x: F.lit(False))), lambda x: row(line(x))), "\n")
    return F.concat(F.lit(head + "\n"), F.when(F.coalesce(body, F.lit("")) == "", "|" + " - |" * len(columns)).otherwise(body))


def markdown(sessions: DataFrame) -> DataFrame:
    """session_id, body: a report of each session with a table of its transcripts and one of its assists."""
    cell = lambda c: t.markdown_cell(c)
    percent = lambda c: F.concat(F.floor(F.coalesce(c, F.lit(0.0)) * 100 + 0.5).cast("string"), F.lit("%"))
    heard = _table_of(F.col("transcripts"), ["Time (UTC)", "Speaker", "Language", "Confidence", "Text"], lambda x: [iso(x["tEndMs"]), x["speaker"], F.upper(F.coalesce(F.nullif(x["language"], F.lit("")), F.lit("unknown"))), percent(x["confidence"]), cell(x["text"])])
    said = _table_of(F.col("assists"), ["State", "LatencyMs", "Confidence", "Parse", "Fallback", "Question TR", "Answer EN", "Helper TR", "Risk Flags", "Review", "Review Tags", "Error"], lambda x: [
        x["state"], F.floor(F.coalesce(x["latencyMs"], F.lit(0.0)) + 0.5).cast("string"), percent(x["confidence"]), F.coalesce(F.nullif(x["parseMode"], F.lit("")), F.lit("n/a")), F.when(x["fallbackUsed"], "yes").otherwise("no"), cell(x["questionTr"]), cell(x["answerEn"]), cell(x["helperAnswerTr"]),
        cell(F.array_join(F.coalesce(x["riskFlags"], F.array().cast("array<string>")), ", ")), cell(F.coalesce(F.nullif(x["reviewLabel"], F.lit("")), F.lit("unreviewed"))), cell(F.array_join(F.coalesce(x["reviewTags"], F.array().cast("array<string>")), ", ")), cell(x["error"])])
    rows = sessions.withColumn("__r", review_counts(F.col("assists")))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    facts = [("Session ID", F.col("id")), ("Started", iso(F.col("startedAtMs"))), ("Ended", iso(F.col("endedAtMs"))), ("STT Model", F.col("sttModel")), ("Inference Model", F.col("inferenceModel")), ("Transcript Count", size("transcripts")), ("Assist Count", size("assists")), ("Reviewed Assists", F.col("__r.reviewed")), ("Chosen Assists", F.col("__r.chosen")), ("Rejected Assists", F.col("__r.rejected"))]
    head = F.concat_ws("\n", F.lit("# Session Export\n"), *[F.concat(F.lit(f"- {name}: "), F.coalesce(v.cast("string"), F.lit(""))) for name, v in facts])
    return rows.select(F.col("id").alias("session_id"), F.concat_ws("\n\n", head, F.lit("## Transcripts"), heard, F.lit("## Assist Outputs"), said).alias("body"))


def export_json(sessions: DataFrame) -> DataFrame:
    """session_id, body: each session as one JSON object."""
    return sessions.select(F.col("id").alias("session_id"), F.to_json(F.struct(*[c for c in sessions.columns if c != "file"])).alias("body"))


def worker_messages(lines: DataFrame) -> DataFrame:
    """NDJSON lines (value) of a worker as typed rows, with defaults; lines that are no JSON objects are left out."""
    rows = lines.select(F.from_json("value", schemas.WORKER).alias("m")).where("m.type IS NOT NULL").select("m.*")
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "text": F.coalesce("text", F.lit("")), "emittedMs": F.coalesce("emittedMs", "tEndMs"), "speaker": F.coalesce("speaker", F.lit("remote"))})


def token_stream(lines: DataFrame) -> DataFrame:
    """stream_id, text, first_ms of token lines (stream_id, pos, ms, value), NDJSON or server-sent events."""
    data = F.regexp_replace("value", r"^data:\s*", "")
    delta = "message STRUCT<content: STRING>, choices ARRAY<STRUCT<delta: STRUCT<content: STRING>>>"
    rows = lines.where(data != "[DONE]").select("stream_id", "pos", "ms", F.from_json(data, delta).alias("d"))
    rows = rows.select("stream_id", "pos", "ms", F.coalesce("d.message.content", F.try_element_at(F.col("d.choices"), F.lit(1))["delta"]["content"]).alias("token")).where("token IS NOT NULL")
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return rows.groupBy("stream_id").agg(F.array_join(tokens, "").alias("text"), F.min(F.when(F.col("token") != "", F.col("ms"))).alias("first_ms"))


def corpus_sources(corpus: DataFrame, limit: int = 120) -> DataFrame:
    """Profile sources of the first corpus rows (with ord) that have 120 characters of text."""
    rows = corpus.where(F.length(t.strip(F.col("text"))) >= 120).orderBy("ord").limit(limit)
    return rows.select(F.substring(F.concat(F.lit("WEB "), F.col("title")), 1, 140).alias("name"), F.lit("web_corpus").alias("type"), "text")


def glossary_sources(glossary: DataFrame) -> DataFrame:
    """Profile sources of glossary rows with 16 characters of content."""
    content = F.concat_ws("\n", F.concat(F.lit("Term: "), F.col("term")), F.concat(F.lit("Definition: "), F.nullif("definition_en", F.lit(""))), F.concat(F.lit("TR: "), F.nullif("definition_tr", F.lit(""))))
    return glossary.select(F.substring(F.concat(F.lit("GLOSSARY "), F.col("term")), 1, 120).alias("name"), F.lit("glossary").alias("type"), content.alias("text")).where(F.length("text") >= 16)


def repositories(repos: DataFrame, only: list[str] | None = None, limit: int = 8) -> DataFrame:
    """Repositories (name, fork, ord) that are no forks, by name where names are given; the first ``limit``."""
    rows = repos.where(~F.coalesce("fork", F.lit(False)))
    if only:
        rows = rows.where(F.lower("name").isin([x.lower() for x in only]))
    return rows.orderBy("ord").limit(limit)


def replace_sources(sources: DataFrame) -> DataFrame:
    """The last source (by importedAtMs, then by its other columns) of each type and lower-cased name; a partial aggregate, not a window."""
    order = F.struct("importedAtMs", *[c for c in sorted(sources.columns) if c != "importedAtMs" and dict(sources.dtypes)[c].split("<")[0] not in ("map",)])
    kept = sources.groupBy("type", F.lower("name").alias("__name")).agg(F.max_by(F.struct(*sources.columns), order).alias("s"))
    return kept.select("s.*")
