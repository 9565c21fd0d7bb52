"""Queries that bring collections into one: importers, merges, judges, reports, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogmill.functions import constants as K
from dialogmill.functions import scoring as sc
from dialogmill.functions import similarity as sim
from dialogmill.functions import text as t
from dialogmill.operators import imports as im
from dialogmill.operators import quota, records
from dialogmill.operators.state import kept
from dialogmill.plans import dataset_queries as dq
from dialogmill.plans import sql as q
from dialogmill.plans import text_queries as _tq  # noqa: F401  its SQL is used here
from dialogmill.plans.base import pairs, query, table
from dialogmill.sources import files
from dialogmill.sources import sessions as ss

C = F.col
md5 = lambda c: F.md5(c.cast("binary"))
LEAST, MOST, CAP = 35, 320, 2500
#: The importers' own queries keep answers from so many words on; the merged collection asks for LEAST.
SINGLE = 12


# --- importers: the conversations in the forms of three collections


def _joined(spark, sf_dir, line, between):
    """conv_id, text: each conversation as one text."""
    rows = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return rows.select("conv_id", F.array_join("lines", between).alias("text"))


def _interviews(spark, sf_dir, least=LEAST):
    line = F.concat(F.when(C("role") == "user", "User").otherwise("Assistant"), F.lit(": "), C("text"))
    found = im.transcript_pairs(_joined(spark, sf_dir, line, "\n")).select("conv_id", "place", "question", "answer")
    return im.import_rows(found, "interviews", least=least, most=MOST).withColumn("ord", C("conv_id") * 1000 + C("place"))


def _dialogues(spark, sf_dir, least=LEAST):
    line = F.concat(F.when(C("role") == "user", "\n\nHuman: ").otherwise("\n\nAssistant: "), C("text"))
    found = _joined(spark, sf_dir, line, "").select("conv_id", im.last_exchange(C("text")).alias("x")).where("x IS NOT NULL").select("conv_id", "x.*")
    return im.import_rows(found, "dialogues", least=least, most=MOST).withColumn("ord", C("conv_id"))


def _messages(spark, sf_dir):
    """The conversations as a tree of messages, in which each turn names the one before."""
    rows = table(spark, sf_dir, "conversations")
    ident = lambda turn: F.concat(C("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    lang = F.element_at(F.array(*map(F.lit, ["en", "en", "tr", "de"])), (C("conv_id") % 4 + 1).cast("int"))
    return rows.select((C("conv_id") * 1000 + C("turn")).alias("ord"), ident(C("turn")).alias("message_id"), ident(C("turn") - 1).alias("parent_id"), F.when(C("role") == "user", "prompter").otherwise(C("role")).alias("role"), "text", lang.alias("lang"), (C("conv_id") % 7 == 0).alias("deleted"), F.when(C("turn") % 6 == 5, C("conv_id") % 2 == 0).alias("review_result"))


def _tree(spark, sf_dir, least=LEAST):
    found = im.tree_pairs(_messages(spark, sf_dir))
    return im.import_rows(found, "tree", C("lang"), least, MOST)


_text = lambda line, between: f"SELECT conv_id, string_agg({line}, {between} ORDER BY turn) AS text FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1"
_LINE = "(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END) || ': ' || text"
_HUMAN = "(CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' ELSE chr(10) || chr(10) || 'Assistant: ' END) || text"
_NL2 = "chr(10) || chr(10) || "
_IMPORTS = rf"""
it AS ({_text(_LINE, 'chr(10)')}), iseg AS (SELECT conv_id, string_split(regexp_replace(text, '(?m)^\s*(Assistant|AI|User):\s*', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:] AS s FROM it),
ip AS (SELECT conv_id, unnest(range(len(s) - 1)) AS place, s FROM iseg), interview_pairs AS (SELECT conv_id, place, {q.normalize("split_part(s[place + 1], chr(2), 2)")} AS question, {q.normalize("split_part(s[place + 2], chr(2), 2)")} AS answer FROM ip WHERE split_part(s[place + 1], chr(2), 1) IN ('Assistant', 'AI') AND split_part(s[place + 2], chr(2), 1) = 'User'),
ht AS ({_text(_HUMAN, "''")}), hs AS (SELECT conv_id, string_split(text, {_NL2}'Human:')[2:] AS s FROM ht), hw AS (SELECT conv_id, s, list_filter(range(1, len(s) + 1), lambda i: contains(s[i], {_NL2}'Assistant:')) AS w FROM hs),
hq AS (SELECT conv_id, array_to_string(s[coalesce(w[len(w) - 1], 0) + 1 : w[len(w)]], {_NL2}'Human:') AS x FROM hw WHERE len(w) > 0), dialogue_pairs AS (SELECT conv_id, {q.normalize(f"substr(x, 1, instr(x, {_NL2}'Assistant:') - 1)")} AS question, {q.normalize(f"substr(x, instr(x, {_NL2}'Assistant:') + 12)")} AS answer FROM hq),
ms AS (SELECT conv_id * 1000 + turn AS ord, conv_id || '-' || turn AS message_id, conv_id || '-' || (turn - 1) AS parent_id, CASE role WHEN 'user' THEN 'prompter' ELSE role END AS role, text, (['en', 'en', 'tr', 'de'])[conv_id % 4 + 1] AS lang, conv_id % 7 = 0 AS deleted, CASE WHEN turn % 6 = 5 THEN conv_id % 2 = 0 END AS review FROM conversations),
tree_pairs AS (SELECT a.ord, a.message_id, a.parent_id, a.lang, p.text AS question, a.text AS answer FROM ms a JOIN ms p ON p.message_id = a.parent_id AND p.role = 'prompter' WHERE a.role = 'assistant' AND NOT a.deleted AND coalesce(a.review, true) AND a.lang IN ('en', 'tr'))"""


def _kept_sql(source: str, pairs_of: str, language: str, order: str, others: str, least: int = LEAST) -> str:
    """The importer's rows of a relation of pairs."""
    quest, ans = q.normalize("question"), q.normalize("answer")
    low, raw = f"lower({quest} || chr(10) || {ans})", "lower(question || chr(10) || answer)"
    terms = sc.import_terms()
    category = q.classify_import("question", "answer")
    fixed = f"(20 + (CASE WHEN contains(question, '?') THEN 10 ELSE 0 END) + (CASE WHEN {category} IN ('nlp_and_llm', 'mlops_infra', 'behavioral_interview') THEN 10 ELSE 0 END) + (CASE WHEN length(answer) > 120 THEN 5 ELSE 0 END))"
    score = f"round(least(0.95::DOUBLE, {fixed} / 100.0::DOUBLE + least({q.words('answer')} / 180.0::DOUBLE, 1.0::DOUBLE) * 0.35::DOUBLE + least({q.contains_count(raw, terms)} / 4.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE), 4)"
    english, turkish = f"(CASE WHEN {language} = 'tr' THEN '' ELSE {ans} END)", f"(CASE WHEN {language} = 'tr' THEN {ans} ELSE '' END)"
    return f"""SELECT substr(sha1('{source}|' || {quest} || '|' || {english} || '|' || {turkish}), 1, 16) AS id, {quest} AS question, {english} AS reply_en, {turkish} AS reply_tr, '{source}' AS source, {category} AS category, {language} AS language, {score} AS quality_score, {order} AS ord{others}
  FROM {pairs_of} WHERE {ans} <> '' AND length({quest}) >= 12 AND {q.words('answer')} BETWEEN {least} AND {MOST} AND regexp_matches({low}, '{q.any_of(terms)}')"""


_INTERVIEWED = "interviews", "interview_pairs", "'en'", "conv_id * 1000 + place", ", conv_id, place"
_DIALOGUED = "dialogues", "dialogue_pairs", "'en'", "conv_id", ""
_ANSWERED = "tree", "tree_pairs", "lang", "ord", ", message_id, parent_id"
_INTERVIEWS, _DIALOGUES, _TREE = (_kept_sql(*x) for x in (_INTERVIEWED, _DIALOGUED, _ANSWERED))


@query(f"WITH {_IMPORTS}, r AS ({_kept_sql(*_INTERVIEWED, least=SINGLE)}) SELECT id, conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1)::INT AS pair_index, md5(question) AS question_md5, md5(reply_en) AS reply_md5, category, quality_score FROM r")
def interview_import(spark, sf_dir):
    """Transcripts with role marks: pairs of the interviewer's turn and the user's, those that are kept numbered from 0."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1
    return _interviews(spark, sf_dir, SINGLE).select("id", "conv_id", index.alias("pair_index"), md5(C("question")).alias("question_md5"), md5(C("reply_en")).alias("reply_md5"), "category", "quality_score")


@query(f"WITH {_IMPORTS}, r AS ({_kept_sql(*_DIALOGUED, least=SINGLE)}) SELECT id, ord AS conv_id, md5(question) AS question_md5, md5(reply_en) AS reply_md5, category, quality_score FROM r")
def dialogue_import(spark, sf_dir):
    """The last exchange of each dialogue."""
    return _dialogues(spark, sf_dir, SINGLE).select("id", "conv_id", md5(C("question")).alias("question_md5"), md5(C("reply_en")).alias("reply_md5"), "category", "quality_score")


@query(f"WITH {_IMPORTS}, r AS ({_kept_sql(*_ANSWERED, least=SINGLE)}) SELECT id, message_id, parent_id, language, md5(reply_en) AS reply_en_md5, md5(reply_tr) AS reply_tr_md5, category, quality_score FROM r")
def message_tree(spark, sf_dir):
    """Answers of a tree of messages with their questions."""
    return _tree(spark, sf_dir, SINGLE).select("id", "message_id", "parent_id", "language", md5(C("reply_en")).alias("reply_en_md5"), md5(C("reply_tr")).alias("reply_tr_md5"), "category", "quality_score")


def _imported(spark, sf_dir):
    cols = ["id", "question", "reply_en", "reply_tr", "source", "category", "language", "quality_score", "ord"]
    return im.import_all([x(spark, sf_dir).select(*cols) for x in (_interviews, _tree, _dialogues)], CAP)


_CHAIN = f"""{_IMPORTS}, i0 AS ({_INTERVIEWS}), t0 AS ({_TREE}), d0 AS ({_DIALOGUES}),
i1 AS (SELECT * FROM (SELECT *, question || '|' || reply_en AS k FROM i0 QUALIFY row_number() OVER (PARTITION BY question || '|' || reply_en ORDER BY ord) = 1) ORDER BY ord LIMIT {CAP}),
t1 AS (SELECT * FROM (SELECT *, question || '|' || reply_en AS k FROM t0 QUALIFY row_number() OVER (PARTITION BY question || '|' || reply_en ORDER BY ord) = 1) WHERE k NOT IN (SELECT k FROM i1) ORDER BY ord LIMIT {CAP}),
d1 AS (SELECT * FROM (SELECT *, question || '|' || reply_en AS k FROM d0 QUALIFY row_number() OVER (PARTITION BY question || '|' || reply_en ORDER BY ord) = 1) WHERE k NOT IN (SELECT k FROM i1) AND k NOT IN (SELECT k FROM t1) ORDER BY ord LIMIT {CAP}),
imported AS (SELECT id, question, reply_en, reply_tr, source, category, language, quality_score, ord FROM i1 UNION ALL SELECT id, question, reply_en, reply_tr, source, category, language, quality_score, ord FROM t1 UNION ALL SELECT id, question, reply_en, reply_tr, source, category, language, quality_score, ord FROM d1)"""


@query(f"WITH {_CHAIN} SELECT id, source, category, language, quality_score, ord FROM imported")
def import_all(spark, sf_dir):
    """The three importers one after another, without what an earlier one has, each up to its cap."""
    return _imported(spark, sf_dir).select("id", "source", "category", "language", "quality_score", "ord")


@query(f"WITH {_CHAIN} SELECT 'source' AS counter, source AS name, count(*)::BIGINT AS n FROM imported GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM imported GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM imported GROUP BY 2")
def import_report(spark, sf_dir):
    return im.import_counters(_imported(spark, sf_dir))


# --- merges and judges


def _records(spark, sf_dir):
    return dq._sft(spark, sf_dir).withColumn("ord", C("conv_id") * 1000 + C("turn"))


_USER = f"CASE WHEN prior <> '' THEN 'Prior Turn Summary:' || chr(10) || prior || chr(10) || chr(10) || 'Relevant Context Lines:' || chr(10) || '- ' || {q.normalize('prior')} || chr(10) || chr(10) ELSE '' END || 'Latest Interviewer Question:' || chr(10) || {q.normalize('question')}"


def _merged(spark, sf_dir):
    """Records of every third conversation, then all, then those of the first ones with another bucket."""
    rows = _records(spark, sf_dir).select("schema_version", "messages", "metadata", "ord", "conv_id")
    third = rows.where("conv_id % 3 = 1").withColumn("metadata", C("metadata").withField("source_bucket", F.lit("curated")))
    return records.merge_records([third, rows, rows.where("conv_id < 10").withColumn("schema_version", F.lit("sft.v1"))])


_MERGED = f"""{dq._SFT_SQL}, u AS (SELECT conv_id, turn, conv_id * 1000 + turn AS ord, {_USER} AS said_user, said FROM e),
m AS (SELECT 0 AS set_no, ord, conv_id, turn FROM u WHERE conv_id % 3 = 1 UNION ALL SELECT 1, ord, conv_id, turn FROM u),
mk AS (SELECT m.set_no, m.ord, CASE m.set_no WHEN 0 THEN 'curated' ELSE 'session' END AS source, {q.key("said_user || '|' || spoken")} AS k FROM m JOIN u USING (conv_id, turn) JOIN spoken USING (conv_id, turn)),
merged AS (SELECT *, md5(k) AS key FROM mk QUALIFY row_number() OVER (PARTITION BY k ORDER BY set_no, ord) = 1)"""


def _with_spoken(rest: str) -> str:
    """The records' answers in their spoken form, by the query that has them."""
    from dialogmill.plans.base import SQL

    return f"WITH RECURSIVE spoken AS (SELECT split_part(substr(id, 2), '-', 1)::BIGINT AS conv_id, split_part(substr(id, 2), '-', 2)::BIGINT AS turn, spoken FROM ({SQL['speakable']}) WHERE id[1] = 'p'), {rest}"


@query(_with_spoken(f"{_MERGED} SELECT key, source, CASE WHEN row_number() OVER (ORDER BY md5('merge|' || key)) <= greatest(1, floor((SELECT count(*) FROM merged) * 0.08::DOUBLE)) AND (SELECT count(*) FROM merged) > 1 THEN 'valid' ELSE 'train' END AS split FROM merged"))
def canonical_merge(spark, sf_dir):
    """Several sets of records as one: the first of each prompt, dealt into train and valid by a shuffle."""
    return quota.train_valid_split(_merged(spark, sf_dir), "key", 0.08, "merge").select("key", "source", "split")


@query(_with_spoken(f"{_MERGED} SELECT source, count(*)::BIGINT AS n FROM merged GROUP BY 1"))
def merge_report(spark, sf_dir):
    return _merged(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _verdicts(spark, sf_dir):
    """Rule verdicts of the pairs; labels of documents stand for another judge's of some."""
    rows = pairs(spark, sf_dir).withColumn("quality", sc.answer_hundredths(C("answer"), C("question")) / 100.0)
    rows = rows.select((C("conv_id") * 10 + C("turn")).alias("id"), "conv_id", "turn", sc.rule_judge(C("answer"), C("quality"), C("turn") % 3 == 0).alias("j"), t.failure_tags(C("answer")).alias("failures"))
    rules = rows.select("id", "conv_id", "turn", C("j.passed").alias("passed"), C("j.average").alias("average"), "failures")
    other = table(spark, sf_dir, "labels").select(C("doc_id").alias("id"), (C("quality") == 1).alias("passed"), F.when(C("quality") == 1, 4.5).otherwise(2.25).alias("average"), F.when(C("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("failures"))
    return rules, other


def _judge_sql() -> str:
    from dialogmill.plans.base import SQL

    return f"""j AS ({SQL['judge']}), f AS (SELECT conv_id, turn, {q.failure_tags('answer')} AS failures FROM pairs),
jm AS (SELECT j.conv_id * 10 + j.turn AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'hybrid' ELSE 'rules' END AS provider, CASE WHEN l.doc_id IS NOT NULL THEN l.quality = 1 ELSE j.passed END AS passed, round(CASE WHEN l.doc_id IS NOT NULL THEN (CASE WHEN l.quality = 1 THEN 4.5::DOUBLE ELSE 2.25::DOUBLE END) ELSE j.average END, 4) AS average,
  CASE WHEN l.toxic = 1 THEN 'toxic' ELSE f.failures END AS failures, CASE WHEN l.doc_id IS NOT NULL THEN j.passed END AS rule_passed FROM j JOIN f USING (conv_id, turn) LEFT JOIN labels l ON l.doc_id = j.conv_id * 10 + j.turn)"""


@query(f"WITH {q.PAIRS}, {_judge_sql()} SELECT * FROM jm")
def judge_merge(spark, sf_dir):
    """Verdicts of the rules, overridden where another judge has one."""
    out = records.judge_merge(*_verdicts(spark, sf_dir))
    return out.withColumn("failures", F.array_join("failures", ","))


@query(f"WITH {q.PAIRS}, {_judge_sql()}, k AS (SELECT *, {q.keep_answer('answer')} AS fit FROM pairs) SELECT id, CASE WHEN passed THEN 'accepted' ELSE 'rejected' END AS judge_status FROM jm JOIN k ON k.conv_id * 10 + k.turn = jm.id WHERE fit")
def judge_outputs(spark, sf_dir):
    """Records as the judges leave them: accepted and rejected ones apart, with their status."""
    rules, other = _verdicts(spark, sf_dir)
    rows = _records(spark, sf_dir).select((C("conv_id") * 10 + C("turn")).alias("id"), "metadata")
    accepted, rejected, _ = records.judged(rows, records.judge_merge(rules, other))
    return accepted.unionByName(rejected).select("id", "metadata.judge_status")


# --- reports


def _report(spark, sf_dir):
    """A build's report from the pools of the mix: its ratios, one zero value, and duplicates that were dropped."""
    rows = dq.source_mix(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(md5(t.key(C("text")))).alias("d"))
    one = rows.agg(F.count(F.lit(1)).alias("records_train"), F.avg((C("bucket") == "web_corpus").cast("int")).alias("web_ratio"), F.avg((C("bucket") == "glossary").cast("int")).alias("glossary_ratio"))
    one = one.join(F.broadcast(docs), F.lit(True))
    return one.select(F.lit(0).cast("long").alias("records_train"), "web_ratio", "glossary_ratio", F.lit(0.3).alias("ai_ratio"), F.lit(None).cast("double").alias("behavioral_ratio"), F.lit(0.0).alias("average_quality"), F.lit(0.97).alias("first_person"), F.lit(None).cast("double").alias("speakable"), F.lit(0.0).alias("grounded"), F.lit(1.0).alias("failure_rate"), (C("n") - C("d")).alias("dropped_duplicates"), F.lit(False).alias("blocked"))


GATES = [("dataset_report_blocked", "report_blocked"), ("train_records_below_min", "rows < 1500"), ("web_ratio_below_min", "web_ratio < 0.70"), ("glossary_ratio_above_max", "glossary_ratio > 0.25 + 1e-9"), *[g for g in dq.GATES if g[0] != "train_records_below_min"]]
_NUMBERS = ["web_ratio", "glossary_ratio", "ai_ratio", "behavioral_ratio", "average_quality", "first_person", "speakable", "grounded", "failure_rate", "near_duplicates"]


def _mix_sql() -> str:
    from dialogmill.plans.base import SQL

    return f"mixed AS (SELECT * FROM ({SQL['source_mix']})), dd AS (SELECT count(*) - count(DISTINCT {q.key('text')}) AS dropped FROM documents)"


@query(f"""
WITH {dq._METRICS_SQL}, {_mix_sql()}, mm AS (SELECT avg((bucket = 'web_corpus')::INT) AS web_ratio, avg((bucket = 'glossary')::INT) AS glossary_ratio FROM mixed),
z AS (SELECT a.rows, mm.web_ratio, mm.glossary_ratio, 0.3::DOUBLE AS ai_ratio, 0.0::DOUBLE AS behavioral_ratio, average_quality, 0.97::DOUBLE AS first_person, speakable, grounded, failure_rate, CASE WHEN dropped > 0 THEN greatest(near_duplicates, dropped::DOUBLE / (dropped + a.rows)) ELSE near_duplicates END AS near_duplicates, false AS report_blocked FROM a, mm, dd)
SELECT rows, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)}, concat_ws(',', {', '.join(f"CASE WHEN {test} THEN '{name}' END" for name, test in GATES)}) AS blocked_reasons FROM z
""")
def quality_report(spark, sf_dir):
    """The gate over a build's report: its values count, and what it lacks is counted again from the rows."""
    own = dq._metrics(spark, sf_dir).select("rows", *records.REPORTED, "failure_rate", "near_duplicates")
    out = records.gate(records.qc_metrics(_report(spark, sf_dir), own), [(n, F.expr(test)) for n, test in GATES])
    return out.select("rows", *[F.round(c, 6).alias(c) for c in _NUMBERS], F.array_join("blocked_reasons", ",").alias("blocked_reasons"))


@query(f"SELECT doc_id, CASE WHEN length({q.strip('left(text, (doc_id % 150)::BIGINT)')}) < 80 AND {q.strip('left(text, 100)')} <> '' THEN left(text, 100) ELSE left(text, (doc_id % 150)::BIGINT) END AS picked, CASE WHEN length({q.strip('left(text, (doc_id % 150)::BIGINT)')}) < 80 AND {q.strip('left(text, 100)')} <> '' THEN 'ocr' ELSE 'pdf_text' END AS parser FROM documents")
def text_choice(spark, sf_dir):
    """Embedded and recognised texts of different lengths: which is taken."""
    rows = table(spark, sf_dir, "documents").select("doc_id", files.chosen_text(F.substring(C("text"), F.lit(1), (C("doc_id") % 150).cast("int")), F.substring("text", 1, 100)).alias("x"))
    return rows.select("doc_id", C("x.text").alias("picked"), "x.parser")


@query(f"SELECT p_partkey, 'How would you explain ' || {q.normalize('p_name')} || ' and the main engineering tradeoffs?' AS of_title, 'How would you explain ' || {q.normalize('p_name')} || ' in a technical interview?' AS of_term, p_name || ' is a software engineering concept frequently discussed in technical interviews. It should be explained with practical usage, tradeoffs, and production impact.' AS definition FROM part")
def question_templates(spark, sf_dir):
    from dialogmill.functions import live as fl

    return table(spark, sf_dir, "part").select("p_partkey", records.question_of("title", C("p_name")).alias("of_title"), records.question_of("term", C("p_name")).alias("of_term"), fl.definition(C("p_name")).alias("definition"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(' ' || source || ', ' || lang || ',,' || lang || ' ', ','), lambda x: {q.strip('x')}), lambda x: x <> '')[1:2], ',') AS tags FROM documents")
def review_tags(spark, sf_dir):
    """Tags with blanks, an empty one and a repeated one."""
    raw = F.split(F.concat(F.lit(" "), C("source"), F.lit(", "), C("lang"), F.lit(",,"), C("lang"), F.lit(" ")), ",")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sim.clean_tags(raw), ",").alias("tags"))


# --- sessions: the conversations as recorded sessions


def _heard(spark, sf_dir):
    """Transcripts and assists of all conversations, and the sessions they belong to."""
    rows = table(spark, sf_dir, "conversations")
    at = C("conv_id") * 100_000 + C("turn") * 1000 + 1
    key = F.concat(F.lit("s"), C("conv_id").cast("string")).alias("session_id")
    heard = rows.where("role = 'user'").select(key, C("turn").alias("ord"), F.concat(F.lit("t"), C("turn").cast("string")).alias("id"), F.lit("remote").alias("speaker"), "text", F.lit("en").alias("language"), F.lit(0.9).alias("confidence"), at.alias("tEndMs"), at.alias("emittedMs"))
    label = F.element_at(F.array(F.lit("chosen"), F.lit("rejected"), F.lit("skipped"), F.lit(None)), ((C("conv_id") + C("turn")) % 4 + 1).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    said = rows.where("role = 'assistant'").select(
        key, C("turn").alias("ord"), F.concat(F.lit("a"), C("turn").cast("string")).alias("id"), F.concat(F.lit("t"), (C("turn") - 1).cast("string")).alias("transcriptId"), F.when(C("turn") % 4 == 1, F.concat(F.lit("Question "), C("turn").cast("string"))).alias("sourceText"), C("text").alias("answerEn"), (C("turn") / 10.0).alias("confidence"), (C("turn") * 100.5).alias("latencyMs"),
        label.alias("reviewLabel"), F.array(F.lit(" a "), F.lit("a"), F.lit("")).alias("reviewTags"), F.when(C("turn") % 5 == 4, "partial").otherwise("final").alias("state"), none("string").alias("reviewComment"), none("string").alias("questionTr"), none("string").alias("helperAnswerTr"), none("string").alias("error"), none("string").alias("parseMode"), (C("turn") % 2 == 0).alias("fallbackUsed"), none("array<string>").alias("riskFlags"))
    ids = rows.select("conv_id").distinct().select(F.concat(F.lit("s"), C("conv_id").cast("string")).alias("id"), (C("conv_id") * 100_000 + 1).alias("startedAtMs"), (C("conv_id") * 100_000 + 90_000).alias("endedAtMs"), F.lit("stt").alias("sttModel"), F.lit("model").alias("inferenceModel"))
    return heard, said, ids


def _sessions(spark, sf_dir):
    return ss.normalized(ss.snapshots(*_heard(spark, sf_dir)))


_HEARD = """
h AS (SELECT conv_id, 's' || conv_id AS sid, turn, text, conv_id * 100000 + turn * 1000 + 1 AS ms FROM conversations WHERE role = 'user'),
s0 AS (SELECT conv_id, 's' || conv_id AS sid, turn, CASE WHEN turn % 4 = 1 THEN 'Question ' || turn END AS asked, text AS answer, (['chosen', 'rejected', 'skipped', 'unreviewed'])[(conv_id + turn) % 4 + 1] AS label, CASE WHEN turn % 5 = 4 THEN 'partial' ELSE 'final' END AS state FROM conversations WHERE role = 'assistant'),
s1 AS (SELECT * FROM s0 WHERE state <> 'partial'), ids AS (SELECT DISTINCT conv_id, 's' || conv_id AS sid FROM conversations),
hc AS (SELECT sid, count(*) AS n, string_agg('| ' || strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || ' | remote | EN | 90% | ' || regexp_replace(replace(text, '|', '\\|'), '\\r?\\n', ' ', 'g') || ' |', chr(10) ORDER BY turn) AS body FROM h GROUP BY 1),
sc AS (SELECT sid, count(*) AS n, count(*) FILTER (label IN ('chosen', 'rejected')) AS reviewed, count(*) FILTER (label = 'chosen') AS chosen, count(*) FILTER (label = 'rejected') AS rejected,
  string_agg('| final | ' || floor(turn * 100.5::DOUBLE + 0.5)::BIGINT || ' | ' || floor(turn / 10.0::DOUBLE * 100 + 0.5)::BIGINT || '% | n/a | ' || (CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END) || ' |  | ' || regexp_replace(replace(answer, '|', '\\|'), '\\r?\\n', ' ', 'g') || ' |  |  | ' || label || ' | a |  |', chr(10) ORDER BY turn) AS body FROM s1 GROUP BY 1),
se AS (SELECT i.conv_id, i.sid, coalesce(hc.n, 0)::INT AS transcripts, coalesce(sc.n, 0)::INT AS assists, coalesce(reviewed, 0)::INT AS reviewed, coalesce(chosen, 0)::INT AS chosen, coalesce(rejected, 0)::INT AS rejected, hc.body AS heard, sc.body AS said FROM ids i LEFT JOIN hc USING (sid) LEFT JOIN sc USING (sid) WHERE hc.n > 0 OR sc.n > 0)""".replace("\\\\", "\\")


@query(f"WITH {_HEARD} SELECT sid AS id, conv_id * 100000 + 1 AS started, transcripts, assists, reviewed, chosen, rejected FROM se ORDER BY started DESC LIMIT 40")
def session_list(spark, sf_dir):
    """The latest sessions with their counts."""
    return ss.session_list(_sessions(spark, sf_dir), 40).select("id", C("startedAtMs").alias("started"), "transcripts", "assists", "reviewed", "chosen", "rejected")


_MD_HEAD = "| Time (UTC) | Speaker | Language | Confidence | Text |", "| State | LatencyMs | Confidence | Parse | Fallback | Question TR | Answer EN | Helper TR | Risk Flags | Review | Review Tags | Error |"
_iso = lambda ms: f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


@query(f"""
WITH {_HEARD} SELECT sid AS session_id, md5('# Session Export' || chr(10) || chr(10) || '- Session ID: ' || sid || chr(10) || '- Started: ' || {_iso('conv_id * 100000 + 1')} || chr(10) || '- Ended: ' || {_iso('conv_id * 100000 + 90000')} || chr(10) || '- STT Model: stt' || chr(10) || '- Inference Model: model' || chr(10) || '- Transcript Count: ' || transcripts || chr(10) || '- Assist Count: ' || assists || chr(10)
  || '- Reviewed Assists: ' || reviewed || chr(10) || '- Chosen Assists: ' || chosen || chr(10) || '- Rejected Assists: ' || rejected || chr(10) || chr(10) || '## Transcripts' || chr(10) || chr(10) || '{_MD_HEAD[0]}' || chr(10) || '|{" --- |" * 5}' || chr(10) || coalesce(heard, '|{" - |" * 5}') || chr(10) || chr(10) || '## Assist Outputs' || chr(10) || chr(10) || '{_MD_HEAD[1]}' || chr(10) || '|{" --- |" * 12}' || chr(10) || coalesce(said, '|{" - |" * 12}')) AS body_md5 FROM se
""")
def session_markdown(spark, sf_dir):
    """Each session's report."""
    return ss.markdown(_sessions(spark, sf_dir)).select("session_id", md5(C("body")).alias("body_md5"))


@query(f"WITH {_HEARD} SELECT s1.sid AS session_id, s1.turn AS place, md5(coalesce(s1.asked, h.text)) AS question_md5, md5(s1.answer) AS answer_md5 FROM s1 LEFT JOIN h ON h.sid = s1.sid AND h.turn = s1.turn - 1")
def session_questions(spark, sf_dir):
    """Final assists with the question they answer: their own text, else that of their transcript."""
    rows = ss.assist_questions(_sessions(spark, sf_dir).withColumn("assists", F.transform("assists", lambda x: x.withField("place", F.substring(x["id"], F.lit(2), F.length(x["id"])).cast("long")))))
    return rows.select("session_id", "place", md5(C("question")).alias("question_md5"), md5(C("answer")).alias("answer_md5"))


# --- the whole build: five pools, filters, duplicates, the mix and the split


def _pools(spark, sf_dir):
    """The rows of the five pools that stay, and how many are dropped by reason: prebuilt records, sessions, documents as a web corpus, imported pairs and parts as a glossary."""
    cols = ["id", "ord", "question", "answer", "hint", "fit", "category", "source"]
    none = lambda kind: F.lit(None).cast(kind)
    made = pairs(spark, sf_dir).where("conv_id % 10 = 0").select(F.concat_ws("|", F.lit("p"), C("conv_id").cast("string"), C("turn").cast("string")).alias("id"), (C("conv_id") * 1000 + C("turn")).alias("ord"), "question", "answer", none("double").alias("hint"), none("boolean").alias("fit"), none("string").alias("category"), F.lit("prebuilt").alias("source"))
    asked = ss.assist_questions(_sessions(spark, sf_dir))
    asked = asked.select(F.concat_ws("|", "session_id", "id").alias("id"), (F.substring("session_id", 2, 20).cast("long") * 1000 + F.substring("id", 2, 20).cast("long")).alias("ord"), "question", "answer", none("double").alias("hint"), none("boolean").alias("fit"), none("string").alias("category"), F.lit("session").alias("source"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.least(F.lit(1.0), C("n_chars") / 5000.0).alias("hint"))
    docs = docs.withColumn("fit", (C("hint") >= 0.35) & (F.length(t.normalize(C("text"))) >= 900))
    web = docs.select(F.concat(F.lit("w|"), C("doc_id").cast("string")).alias("id"), C("doc_id").alias("ord"), records.question_of("title", C("source")).alias("question"), F.when(C("fit"), t.corpus_summary(F.when(C("lang") == "en", C("text")).otherwise(""), C("source"))).alias("answer"), "hint", "fit", none("string").alias("category"), F.lit("web_corpus").alias("source"))
    other = _imported(spark, sf_dir).select(F.concat_ws("|", "source", C("ord").cast("string")).alias("id"), (F.when(C("source") == "interviews", 0).when(C("source") == "tree", 1).otherwise(2) * 10**12 + C("ord")).alias("ord"), "question", C("reply_en").alias("answer"), C("quality_score").alias("hint"), none("boolean").alias("fit"), "category", F.lit("external_qa").alias("source"))
    from dialogmill.functions import live as fl

    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("g|"), C("p_partkey").cast("string")).alias("id"), C("p_partkey").alias("ord"), records.question_of("term", C("p_name")).alias("question"), fl.glossary_answer(C("p_name"), C("p_type")).alias("answer"), none("double").alias("hint"), (t.normalize(C("p_name")) != "").alias("fit"), F.lit("glossary").alias("category"), F.lit("glossary").alias("source"))
    of = ((made, "session-prebuilt", "session", "session_filter"), (asked, "session", "session", "session_filter"), (web, "web", "web_corpus", "corpus_filter"), (other, "external", "web_corpus", "external_filter"), (parts, "glossary", "glossary", "glossary_filter"))
    out = None
    for rows, name, bucket, fault in of:
        one = rows.select(*cols, F.lit(name).alias("pool"), F.lit(bucket).alias("bucket"), F.lit(fault).alias("fault"))
        out = one if out is None else out.unionByName(one)
    return records.pooled(out)


def _mixed(rows):
    return quota.source_mix(rows, "bucket", "id", 0.3, 0.0, 0.25)


_EXTERNAL_ORD = "CASE source WHEN 'interviews' THEN 0 WHEN 'tree' THEN 1 ELSE 2 END * 1000000000000 + ord"
_BUILD = f"""
{_CHAIN.strip()}, {q.PAIRS}, {_HEARD},
w0 AS (SELECT *, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS hint FROM documents), w1 AS MATERIALIZED (SELECT doc_id, lang, source, hint, {q.normalize("text")} AS whole, {q.normalize("CASE WHEN lang = 'en' THEN text ELSE '' END")} AS x FROM w0),
w2 AS (SELECT *, {q.strip(f"array_to_string(list_filter(list_transform(string_split(replace(x, chr(10), ' '), '. '), lambda s: {q.strip('s')}), lambda s: s <> '')[1:4], '. ')")} AS base FROM w1),
rows0 AS MATERIALIZED (
  SELECT 'p|' || conv_id || '|' || turn AS id, conv_id * 1000 + turn AS ord, question, answer, NULL::DOUBLE AS hint, true AS fit, NULL AS category, 'prebuilt' AS source, 'session-prebuilt' AS pool, 'session' AS bucket, 'session_filter' AS fault FROM pairs WHERE conv_id % 10 = 0
  UNION ALL SELECT s1.sid || '|a' || s1.turn, s1.conv_id * 1000 + s1.turn, coalesce(s1.asked, h.text), s1.answer, NULL, true, NULL, 'session', 'session', 'session', 'session_filter' FROM s1 LEFT JOIN h ON h.sid = s1.sid AND h.turn = s1.turn - 1
  UNION ALL SELECT 'w|' || doc_id, doc_id, 'How would you explain ' || {q.normalize('source')} || ' and the main engineering tradeoffs?', source || '. ' || CASE WHEN base = '' THEN substr(x, 1, 720) ELSE base END, hint, length(whole) >= 900 AND hint >= 0.35, NULL, 'web_corpus', 'web', 'web_corpus', 'corpus_filter' FROM w2
  UNION ALL SELECT source || '|' || ord, {_EXTERNAL_ORD}, question, reply_en, quality_score, true, category, 'external_qa', 'external', 'web_corpus', 'external_filter' FROM imported
  UNION ALL SELECT 'g|' || p_partkey, p_partkey, 'How would you explain ' || {q.normalize('p_name')} || ' in a technical interview?', 'I would describe ' || p_name || ' as ' || {q.normalize('p_type')} || ' I would then connect it to a concrete production example, explain the tradeoffs, and mention how I would validate the decision in practice.', NULL, {q.normalize('p_name')} <> '', 'glossary', 'glossary', 'glossary', 'glossary', 'glossary_filter' FROM part),
raw AS (SELECT id, {q.normalize('question')} AS question, answer FROM rows0), {_tq.SPOKEN},
r1 AS MATERIALIZED (SELECT z.*, g.x AS spoken, {q.normalize('z.question')} AS quest FROM rows0 z JOIN g USING (id)),
r2 AS MATERIALIZED (SELECT *, CASE WHEN NOT (fit AND quest <> '' AND {q.keep_answer('spoken')}) THEN fault END AS d0, {q.key("pool || '|' || quest || '|' || spoken")} AS sign FROM r1),
r3 AS (SELECT *, coalesce(d0, CASE WHEN row_number() OVER (PARTITION BY sign, d0 IS NULL ORDER BY ord, id) > 1 THEN 'duplicate' END) AS dropped FROM r2),
avail AS MATERIALIZED (SELECT id, bucket, source, coalesce(category, {q.classify('quest', 'spoken')}) AS category, round(greatest(coalesce(hint, 0), {q.answer_hundredths('spoken', 'quest')} / 100.0::DOUBLE), 4) AS quality, spoken, dropped FROM r3),
n AS (SELECT count(*) FILTER (bucket = 'web_corpus') AS w, count(*) FILTER (bucket = 'session') AS s, count(*) FILTER (bucket = 'glossary') AS g FROM avail WHERE dropped IS NULL),
tt AS (SELECT *, least(w + s + g, floor(w / 0.3::DOUBLE)::BIGINT, floor((w + s) / 0.75::DOUBLE)::BIGINT) AS t FROM n), ta AS (SELECT *, least(ceil(0.3::DOUBLE * t)::BIGINT, w) AS w0, 0 AS s0 FROM tt),
tb AS (SELECT *, greatest(0, t - w0 - s0) AS rem, s AS sx1, greatest(0, w - ceil(0.3::DOUBLE * t)::BIGINT) AS wx1 FROM ta), tc AS (SELECT *, least(rem, sx1) AS sx, least(rem - least(rem, sx1), wx1) AS wx FROM tb),
tk AS (SELECT w0 + wx AS web_corpus, s0 + sx AS session, least(rem - sx - wx, g, floor(0.25::DOUBLE * t)::BIGINT) AS glossary FROM tc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('mix|' || id)) AS place FROM avail WHERE dropped IS NULL),
final AS MATERIALIZED (SELECT ranked.* FROM ranked, tk WHERE place <= CASE bucket WHEN 'web_corpus' THEN web_corpus WHEN 'session' THEN session ELSE glossary END)"""


@query(f"WITH {_BUILD} SELECT id, bucket, source, category, quality, md5(spoken) AS answer_md5, CASE WHEN row_number() OVER (ORDER BY md5('build|' || id)) <= greatest(1, floor((SELECT count(*) FROM final) * 0.08::DOUBLE)) THEN 'valid' ELSE 'train' END AS split FROM final")
def sft_build(spark, sf_dir):
    """Training records of all pools, mixed to their ratios and dealt into train and valid."""
    out = quota.train_valid_split(_mixed(_pools(spark, sf_dir)[0]), "id", 0.08, "build")
    return out.select("id", "bucket", "source", "category", "quality", md5(C("answer")).alias("answer_md5"), "split")


@query(f"WITH {_BUILD} SELECT 'dropped' AS counter, dropped AS name, count(*)::BIGINT AS n FROM avail WHERE dropped IS NOT NULL GROUP BY 2 " + " ".join(f"UNION ALL SELECT '{label}_{name}', {name}, count(*) FROM {rel} GROUP BY 2" for label, rel in (("raw", "avail WHERE dropped IS NULL"), ("final", "final")) for name in ("bucket", "source", "category")))
def sft_report(spark, sf_dir):
    """Counters of the build by stage."""
    rows, dropped = _pools(spark, sf_dir)
    return records.build_counters(rows, dropped, _mixed(rows))
