"""Queries that build, check and balance training records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialogmill.functions import constants as K
from dialogmill.functions import scoring as sc
from dialogmill.functions import text as t
from dialogmill.operators import chunks as ch
from dialogmill.operators import dpo, near_dup, quota, records
from dialogmill.operators import percentiles as pc
from dialogmill.operators.state import kept
from dialogmill.operators import pairs as op
from dialogmill.plans import sql as q
from dialogmill.plans.base import documents, pairs, query, table
from dialogmill.plans.text_queries import web_quality_sql

C = F.col


@query(f"WITH {q.PAIRS} SELECT conv_id, turn, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM pairs")
def qa_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.md5(C("question").cast("binary")).alias("question_md5"), F.md5(C("answer").cast("binary")).alias("answer_md5"))


@query(f"WITH {q.PAIRS}, k AS (SELECT {q.classify('question', 'answer')} AS category, {q.answer_hundredths('answer', 'question')} AS h, {q.key('question')} AS qk, row_number() OVER (PARTITION BY {q.key('question')} || '|' || {q.key('answer')} ORDER BY conv_id, turn) AS rn FROM pairs WHERE {q.keep_answer('answer')}) SELECT category, count(*)::BIGINT AS n, sum(h)::BIGINT AS hundredths FROM k WHERE rn = 1 GROUP BY 1")
def qa_flagship(spark, sf_dir):
    """Pairs with a fit answer, the first of equal ones, by category."""
    rows = pairs(spark, sf_dir).where(sc.keep_answer(C("answer")))
    rows = op.keep_first(rows, [F.concat_ws("|", t.key(C("question")), t.key(C("answer")))], ["conv_id", "turn"])
    rows = rows.select(sc.classify(C("question"), C("answer")).alias("category"), sc.answer_hundredths(C("answer"), C("question")).alias("h"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("hundredths"))


@query(f"SELECT min(doc_id)::BIGINT AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY {q.key('text')}")
def dedup_exact(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.md5(t.key(C("text")).cast("binary")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("k")


NEAR = 0.84
_NEAR_SQL = f"""
s AS (SELECT doc_id, {q.token_set('text')} AS s FROM documents),
c AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
x AS MATERIALIZED (SELECT id, s, len(s) AS n FROM c),
near AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s))::DOUBLE / (a.n + b.n - len(list_intersect(a.s, b.s))) AS similarity FROM x a JOIN x b ON a.id < b.id AND b.n >= a.n * {NEAR} AND b.n <= a.n / {NEAR} WHERE len(list_intersect(a.s, b.s))::DOUBLE / (a.n + b.n - len(list_intersect(a.s, b.s))) >= {NEAR})"""


def _classes(spark, sf_dir):
    return near_dup.set_classes(documents(spark, sf_dir).select("doc_id", t.token_set(C("text")).alias("tokens")))


@query(f"WITH {_NEAR_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM near")
def near_pairs(spark, sf_dir):
    return near_dup.similar_pairs(_classes(spark, sf_dir), NEAR).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_NEAR_SQL} SELECT DISTINCT b AS doc_id FROM near")
def dedup_near(spark, sf_dir):
    return near_dup.resolve_any(near_dup.similar_pairs(_classes(spark, sf_dir), NEAR))


@query(f"""
WITH RECURSIVE {_NEAR_SQL}, nb AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM near GROUP BY b),
gr AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT nb.i, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, b) ELSE gone END FROM gr JOIN nb ON nb.i = gr.i + 1)
SELECT unnest(arg_max(gone, i)) AS doc_id FROM gr
""")
def dedup_near_greedy(spark, sf_dir):
    """The rule that compares with accepted documents only."""
    return near_dup.resolve_greedy(near_dup.similar_pairs(_classes(spark, sf_dir), NEAR))


@query(f"WITH {q.PAIRS}, l AS (SELECT *, 'Q: ' || {q.normalize('question')} || ' A: ' || {q.normalize('answer')} AS line FROM pairs), g AS (SELECT conv_id, turn, lag(line, 2) OVER w AS l2, lag(line, 1) OVER w AS l1 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, {q.strip(f'''substr({q.strip(f"concat_ws(' ', {q.normalize('l2')}, {q.normalize('l1')})")}, 1, 420)''')} AS prior FROM g")
def prior_turns(spark, sf_dir):
    return op.prior_turns(pairs(spark, sf_dir)).select("conv_id", "turn", "prior")


@query(f"WITH {q.PAIRS} SELECT conv_id, max(turn)::BIGINT AS turn FROM pairs GROUP BY 1")
def last_pair(spark, sf_dir):
    return op.last_pair(pairs(spark, sf_dir)).select("conv_id", "turn")


@query(f"WITH {q.PAIRS} SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pair_index FROM pairs WHERE {q.words('answer')} >= 30")
def pair_index(spark, sf_dir):
    rows = pairs(spark, sf_dir).where(t.word_count(C("answer")) >= 30)
    return rows.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("pair_index"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25")
def source_cap(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("rn", rn).where("rn <= 25").drop("rn")


@query(f"WITH u AS (SELECT 0 AS src, doc_id AS id, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, text FROM documents WHERE lang = 'en'), k AS (SELECT src, id, row_number() OVER (PARTITION BY {q.key('text')} ORDER BY src, id) AS rn FROM u) SELECT src, id FROM k WHERE rn = 1")
def union_distinct(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    u = docs.where("doc_id % 2 = 0").select(F.lit(0).alias("src"), C("doc_id").alias("id"), "text").unionByName(docs.where("lang = 'en'").select(F.lit(1).alias("src"), C("doc_id").alias("id"), "text"))
    return u.groupBy(F.md5(t.key(C("text")).cast("binary")).alias("k")).agg(F.min(F.struct("src", "id")).alias("f")).select("f.src", "f.id")


@query(f"WITH n AS MATERIALIZED (SELECT doc_id, {q.normalize('text')} AS x, {web_quality_sql('text', 'source')} AS quality FROM documents) SELECT doc_id, length(x)::INT AS chars FROM n WHERE length(x) >= 900 AND quality >= 0.35")
def corpus_filter(spark, sf_dir):
    """Documents that are long and good enough for records."""
    rows = documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", F.length(t.normalize(C("text"))).alias("chars"), sc.web_quality(C("text"), C("source")).alias("quality"))
    return rows.where("chars >= 900 AND quality >= 0.35").select("doc_id", "chars")


def _sft(spark, sf_dir):
    rows = op.prior_turns(pairs(spark, sf_dir).where(sc.keep_answer(C("answer"))))
    rows = rows.withColumn("s", t.speakable(C("answer"), C("question")))
    return records.sft_records(rows.select("conv_id", "turn", "question", C("s.text").alias("answer"), "prior", F.array("prior").alias("context"), F.lit("session_export").alias("source"), F.lit("session").alias("bucket"), sc.classify(C("question"), C("answer")).alias("category"), (sc.answer_hundredths(C("s.text"), C("question")) / 100.0).alias("quality"), C("s.rewritten").alias("rewritten")))


_SFT_SQL = f"""
{q.PAIRS}, kept AS (SELECT * FROM pairs WHERE {q.keep_answer('answer')}),
l AS (SELECT *, 'Q: ' || {q.normalize('question')} || ' A: ' || {q.normalize('answer')} AS line FROM kept),
g AS (SELECT *, lag(line, 2) OVER w AS l2, lag(line, 1) OVER w AS l1 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, {q.strip(f'''substr({q.strip(f"concat_ws(' ', {q.normalize('l2')}, {q.normalize('l1')})")}, 1, 420)''')} AS prior FROM g),
e AS (SELECT *, CASE WHEN NOT {q.first_person('answer')} THEN {q.quoted(K.FIRST_PERSON_PREFIX)} || lower(substr({q.normalize('answer')}, 1, 1)) || substr({q.normalize('answer')}, 2) ELSE {q.normalize('answer')} END AS said FROM h)"""


@query(f"WITH {_SFT_SQL} SELECT conv_id, turn, {q.classify('question', 'answer')} AS category, CASE WHEN prior <> '' THEN 'multi_turn' ELSE 'single_turn' END AS turn_shape, md5(CASE WHEN prior <> '' THEN 'Prior Turn Summary:' || chr(10) || prior || chr(10) || chr(10) || 'Relevant Context Lines:' || chr(10) || '- ' || {q.normalize('prior')} || chr(10) || chr(10) ELSE '' END || 'Latest Interviewer Question:' || chr(10) || {q.normalize('question')}) AS user_md5, 'sft.v2' AS schema_version FROM e")
def sft_records(spark, sf_dir):
    rows = _sft(spark, sf_dir)
    return rows.select("conv_id", "turn", "metadata.category", "metadata.turn_shape", F.md5(F.element_at("messages", 2)["content"].cast("binary")).alias("user_md5"), "schema_version")


MIX = (0.7, 0.2, 0.25)
_BUCKET = "CASE WHEN doc_id % 5 = 0 THEN 'session' WHEN doc_id % 5 < 3 THEN 'glossary' ELSE 'web_corpus' END"


@query(f"""
WITH d AS (SELECT doc_id, {_BUCKET} AS bucket FROM documents), n AS (SELECT count(*) FILTER (bucket = 'web_corpus') AS w, count(*) FILTER (bucket = 'session') AS s, count(*) FILTER (bucket = 'glossary') AS g FROM d),
t AS (SELECT *, least(w + s + g, floor(w / 0.7::DOUBLE)::BIGINT, floor(s / 0.2::DOUBLE)::BIGINT, floor((w + s) / 0.75::DOUBLE)::BIGINT) AS t FROM n),
a AS (SELECT *, least(ceil(0.7::DOUBLE * t)::BIGINT, w) AS w0, least(ceil(0.2::DOUBLE * t)::BIGINT, s) AS s0 FROM t),
b AS (SELECT *, greatest(0, t - w0 - s0) AS rem, greatest(0, s - ceil(0.2::DOUBLE * t)::BIGINT) AS s1, greatest(0, w - ceil(0.7::DOUBLE * t)::BIGINT) AS w1 FROM a),
c AS (SELECT *, least(rem, s1) AS sx, least(rem - least(rem, s1), w1) AS wx FROM b),
k AS (SELECT w0 + wx AS web_corpus, s0 + sx AS session, least(rem - sx - wx, g, floor(0.25::DOUBLE * t)::BIGINT) AS glossary FROM c),
r AS (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('mix|' || doc_id)) AS rank FROM d)
SELECT doc_id, bucket FROM r, k WHERE rank <= CASE bucket WHEN 'web_corpus' THEN web_corpus WHEN 'session' THEN session ELSE glossary END
""")
def source_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BUCKET).alias("bucket"))
    return quota.source_mix(rows, "bucket", "doc_id", *MIX)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('split|' || doc_id)) AS rank, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rank <= greatest(1, floor(n * 0.08::DOUBLE)) THEN 'valid' ELSE 'train' END AS split FROM r")
def train_valid_split(spark, sf_dir):
    return quota.train_valid_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.08)


_KEY = "d.lang || '-' || (d.doc_id % 40)"
_LAB = f"lab AS (SELECT d.doc_id AS pos, {_KEY} AS k, {q.strip('d.text')} AS answer, l.quality, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS tags FROM documents d JOIN labels l USING (doc_id)), smp AS (SELECT doc_id AS pos, {_KEY} AS k, {q.strip('text')} AS answer FROM documents d)"


def _answers(spark, sf_dir):
    """Documents as answers to prompts, keyed by language and a part of the id; as samples: key, completion, pos."""
    key = F.concat(C("lang"), F.lit("-"), (C("doc_id") % 40).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), C("text").alias("answer"), C("doc_id").alias("pos"))


def _reviewed(spark, sf_dir):
    """The labelled ones as reviewed answers: good ones chosen, bad ones rejected, toxic ones tagged."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(C("quality") == 1, "chosen").when(C("quality") == 0, "rejected").alias("label"), F.when(C("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return _answers(spark, sf_dir).join(labels, "doc_id").select("key", "answer", "label", "tags", "pos")


def _legacy(spark, sf_dir):
    rows = _reviewed(spark, sf_dir).withColumn("answer", t.strip(C("answer")))
    return dpo.legacy_pairs(rows.where("label = 'chosen'"), rows.where("label = 'rejected'"))


def _session(spark, sf_dir):
    return dpo.session_pairs(_reviewed(spark, sf_dir), _answers(spark, sf_dir).select("key", C("answer").alias("completion"), "pos"))


_LEGACY_SQL = f"{_LAB}, rej AS (SELECT k, arg_min(answer, pos) AS rejected FROM lab WHERE quality = 0 GROUP BY k), legacy AS (SELECT k AS key, pos, answer AS chosen, rejected FROM lab JOIN rej USING (k) WHERE quality = 1 AND answer <> '' AND rejected <> '' AND answer <> rejected)"
_pick = lambda rel, test: f"(SELECT arg_min(struct_pack(answer := x.answer, ak := x.ak, tags := x.tags), x.pos) FROM {rel} x WHERE x.k = c.k AND x.ak <> c.ak{test})"
_SESSION_SQL = f"""
la AS MATERIALIZED (SELECT k, pos, answer, quality, tags, {q.key('answer')} AS ak FROM lab WHERE answer <> ''), sa AS MATERIALIZED (SELECT k, pos, answer, '' AS tags, {q.key('answer')} AS ak FROM smp WHERE answer <> ''),
pr AS (SELECT c.*, {_pick('la', ' AND x.quality = 1 - c.quality')} AS a, {_pick('sa', '')} AS b FROM la c WHERE c.quality IN (0, 1)),
pp AS (SELECT *, coalesce(a, b) AS f, a IS NOT NULL AS own FROM pr WHERE coalesce(a, b) IS NOT NULL),
po AS (SELECT k AS key, 1 - quality AS direction, pos, CASE WHEN quality = 1 THEN answer ELSE f.answer END AS chosen, CASE WHEN quality = 1 THEN f.answer ELSE answer END AS rejected, CASE WHEN quality = 1 THEN ak ELSE f.ak END AS gk, CASE WHEN quality = 1 THEN f.ak ELSE ak END AS bk,
  CASE WHEN own THEN 'reviewed_session_pair' WHEN quality = 1 THEN 'reviewed_plus_sampled' ELSE 'sampled_repair_pair' END AS source, CASE WHEN quality = 1 THEN (CASE WHEN own THEN f.tags ELSE '' END) ELSE tags END AS own_tags FROM pp),
session AS (SELECT key, direction, pos, chosen, rejected, source, CASE WHEN own_tags <> '' THEN own_tags ELSE {q.failure_tags('rejected')} END AS tags, CASE source WHEN 'reviewed_session_pair' THEN 0.95::DOUBLE WHEN 'reviewed_plus_sampled' THEN 0.88::DOUBLE ELSE 0.84::DOUBLE END AS confidence FROM po QUALIFY row_number() OVER (PARTITION BY key, gk, bk ORDER BY direction, pos) = 1)"""
_md5 = lambda c: F.md5(C(c).cast("binary")).alias(f"{c}_md5")


@query(f"WITH {_LEGACY_SQL} SELECT key, pos, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, 0.8::DOUBLE AS confidence FROM legacy")
def dpo_legacy(spark, sf_dir):
    return _legacy(spark, sf_dir).select("key", "pos", _md5("chosen"), _md5("rejected"), "confidence")


@query(f"WITH {_LAB}, {_SESSION_SQL} SELECT key, direction::INT AS direction, pos, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, source, tags AS reason_tags, confidence FROM session")
def dpo_session(spark, sf_dir):
    return _session(spark, sf_dir).select("key", "direction", "pos", _md5("chosen"), _md5("rejected"), "source", F.array_join("reason_tags", ",").alias("reason_tags"), "confidence")


@query(f"WITH {_LEGACY_SQL}, {_SESSION_SQL} SELECT key, pos, 'legacy' AS source, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, 0.8::DOUBLE AS confidence, {q.failure_tags('rejected')} AS reason_tags FROM legacy UNION ALL SELECT key, pos, source, md5(chosen), md5(rejected), confidence, tags FROM session")
def dpo_union(spark, sf_dir):
    """Legacy pairs, then those of reviewed sessions."""
    legacy = _legacy(spark, sf_dir).withColumn("source", F.lit("legacy")).withColumn("reason_tags", t.failure_tags(C("rejected")))
    cols = ["key", "pos", "source", "chosen", "rejected", "confidence", "reason_tags"]
    both = legacy.select(*cols).unionByName(_session(spark, sf_dir).select(*cols))
    return both.select("key", "pos", "source", _md5("chosen"), _md5("rejected"), "confidence", F.array_join("reason_tags", ",").alias("reason_tags"))


@query(f"""
WITH {_LEGACY_SQL}, {_SESSION_SQL} SELECT 'chosen_rows' AS name, count(*)::BIGINT AS n FROM lab WHERE quality = 1 UNION ALL SELECT 'rejected_rows', count(*) FROM lab WHERE quality = 0 UNION ALL SELECT 'reviewed_session_prompts', count(DISTINCT k) FROM lab WHERE quality IN (0, 1) AND answer <> ''
UNION ALL SELECT 'sampled_prompt_keys', count(DISTINCT k) FROM smp WHERE answer <> '' UNION ALL SELECT 'legacy_pairs', count(*) FROM legacy UNION ALL SELECT 'session_pairs', count(*) FROM session UNION ALL SELECT 'pairs', (SELECT count(*) FROM legacy) + (SELECT count(*) FROM session)
""")
def dpo_report(spark, sf_dir):
    rows = _reviewed(spark, sf_dir)
    return dpo.pair_report(_legacy(spark, sf_dir), _session(spark, sf_dir), rows.where("label = 'chosen'"), rows.where("label = 'rejected'"), rows, _answers(spark, sf_dir).select("key", C("answer").alias("completion"), "pos"))


def _metrics(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(C("answer"), sc.classify(C("question"), C("answer")).alias("category"), (sc.answer_hundredths(C("answer"), C("question"))).alias("h"), (C("turn") % 3 == 0).alias("specific"), t.failure_tags(C("answer")).alias("tags"), t.word_count(C("answer")).alias("w"))
    one = lambda c: F.avg(c.cast("int"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), (F.sum("h") / 100.0 / F.count(F.lit(1))).alias("average_quality"), one(~F.array_contains("tags", "not_first_person")).alias("first_person"),
        one((F.size("tags") == 0) & C("w").between(K.MIN_WORDS, K.MAX_WORDS)).alias("speakable"), one(F.size("tags") > 0).alias("failure_rate"), one(C("category").isin("nlp_and_llm", "mlops_infra")).alias("ai_ratio"), one(C("category") == "behavioral_interview").alias("behavioral_ratio"),
        F.coalesce(F.avg(F.when(C("specific"), (C("h") >= 60).cast("int"))), F.lit(1.0)).alias("grounded"), (1 - F.count_distinct(F.md5(t.qc_fingerprint(C("answer")).cast("binary"))) / F.count(F.lit(1))).alias("near_duplicates"),
    )


_METRICS_SQL = f"""
{q.PAIRS}, m AS (SELECT answer, {q.classify('question', 'answer')} AS category, {q.answer_hundredths('answer', 'question')} AS h, turn % 3 = 0 AS specific, {q.failure_tags('answer')} AS tags, {q.words('answer')} AS w FROM pairs),
a AS (SELECT count(*)::BIGINT AS rows, sum(h) / 100.0::DOUBLE / count(*) AS average_quality, avg((NOT contains(tags, 'not_first_person'))::INT) AS first_person, avg((tags = '' AND w BETWEEN 45 AND 140)::INT) AS speakable, avg((tags <> '')::INT) AS failure_rate,
  avg((category IN ('nlp_and_llm', 'mlops_infra'))::INT) AS ai_ratio, avg((category = 'behavioral_interview')::INT) AS behavioral_ratio, coalesce(avg((h >= 60)::INT) FILTER (specific), 1.0) AS grounded, 1 - count(DISTINCT substr(array_to_string(list_sort({q.tokens('answer')}), '|'), 1, 1000))::DOUBLE / count(*) AS near_duplicates FROM m)"""
_NUMBERS = ["average_quality", "first_person", "speakable", "failure_rate", "ai_ratio", "behavioral_ratio", "grounded", "near_duplicates"]


@query(f"WITH {_METRICS_SQL} SELECT rows, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)} FROM a")
def dataset_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("rows", *[F.round(c, 6).alias(c) for c in _NUMBERS])


GATES = [("train_records_below_min", "rows < 1500"), ("ai_mlops_ratio_below_min", "ai_ratio < 0.20"), ("behavioral_ratio_below_min", "behavioral_ratio < 0.10"), ("behavioral_ratio_above_max", "behavioral_ratio > 0.20 + 1e-9"), ("average_quality_below_min", "average_quality < 0.52"), ("first_person_compliance_below_min", "first_person < 0.95"), ("speakable_ratio_below_min", "speakable < 0.90"), ("candidate_grounded_ratio_below_min", "grounded < 0.80"), ("critical_failure_rate_above_max", "failure_rate > 0.03 + 1e-9"), ("near_duplicate_ratio_above_max", "near_duplicates > 0.03 + 1e-9")]


@query(f"WITH {_METRICS_SQL} SELECT concat_ws(',', {', '.join(f'''CASE WHEN {test} THEN '{name}' END''' for name, test in GATES)}) AS blocked_reasons, ({' OR '.join(test for _, test in GATES)}) AS blocked FROM a")
def quality_gate(spark, sf_dir):
    out = records.gate(_metrics(spark, sf_dir), [(n, F.expr(test)) for n, test in GATES])
    return out.select(F.array_join("blocked_reasons", ",").alias("blocked_reasons"), "blocked")


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last, bool_or(trim(coalesce(text, '')) = '') AS empty FROM conversations GROUP BY 1)
SELECT coalesce(CASE WHEN n < 2 THEN 'messages_missing' WHEN empty THEN 'message_missing_role_or_content' WHEN last <> 'assistant' THEN 'last_role_not_assistant' END, 'usable') AS reason, count(*)::BIGINT AS n FROM c GROUP BY 1
""")
def message_validation(spark, sf_dir):
    chat = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", C("text").alias("content")))).alias("messages"))
    return chat.groupBy(F.coalesce(records.message_fault(C("messages")), F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {q.PAIRS}, n AS (SELECT {q.words('question')} AS p, {q.words('question')} + {q.words('answer')} AS f FROM pairs), k AS (SELECT *, greatest(0, least(f, 120) - least(p, 120)) AS kept FROM n),
s AS (SELECT list_sort(list(p)) AS ps, list_sort(list(f - p)) AS cs, list_sort(list(f)) AS fs, count(*) AS n, count(*) FILTER (kept > 0) AS usable FROM k)
SELECT usable::BIGINT AS kept_rows, (n - usable)::BIGINT AS dropped, ps[n // 2 + 1]::INT AS prompt_p50, cs[n // 2 + 1]::INT AS completion_p50, fs[n // 2 + 1]::INT AS full_p50, fs[n]::INT AS full_max FROM s
""")
def token_budget(spark, sf_dir):
    """Words stand in for tokens; upper medians of three columns, each dealt into ranges, so that no task sorts them all."""
    rows = pairs(spark, sf_dir).select(t.word_count(C("question")).alias("p"), (t.word_count(C("question")) + t.word_count(C("answer"))).alias("f"))
    rows = rows.withColumn("kept", records.completion_budget(C("p"), C("f"), 120))
    long = rows.select(F.explode(F.create_map(F.lit("prompt"), C("p"), F.lit("completion"), C("f") - C("p"), F.lit("full"), C("f"))).alias("kind", "v"))
    medians = pc.ranked_values(long, ["kind"], "v", {"p50": pc.upper_place()})
    of = lambda kind: F.max(F.when(C("kind") == kind, C("p50"))).alias(f"{kind}_p50")
    counts = rows.agg(F.count_if(C("kept") > 0).alias("kept_rows"), F.count_if(C("kept") <= 0).alias("dropped"), F.max("f").alias("full_max"))
    return counts.join(F.broadcast(medians.agg(of("prompt"), of("completion"), of("full"))), F.lit(True)).select("kept_rows", "dropped", "prompt_p50", "completion_p50", "full_p50", "full_max")


SEEDS = ["the", "latency", "thble"]


@query(f"""
WITH k AS (SELECT unnest(list_filter(regexp_extract_all(source || chr(10) || substr(text, 1, 5000), '[A-Za-z][A-Za-z0-9_+\\-]{{2,30}}'), lambda x: lower(x) NOT IN ({q.listed(K.GLOSSARY_STOPWORDS)}))) AS term FROM documents),
f AS (SELECT term, count(*) AS freq FROM k GROUP BY 1 HAVING count(*) >= 4 AND lower(term) NOT IN ({q.listed(SEEDS)})),
b AS (SELECT arg_max(term, struct_pack(f := freq, t := -ascii(term), u := md5(term))) AS term, max(freq) AS freq FROM f GROUP BY lower(term))
SELECT term, freq::BIGINT AS freq FROM b ORDER BY freq DESC, lower(term) LIMIT 300
""")
def glossary_terms(spark, sf_dir):
    """Frequent terms that no seed has; case variants compete and the most frequent one wins."""
    rows = documents(spark, sf_dir, "doc_id", "text", "source")
    terms = rows.select(F.explode(t.glossary_tokens(F.concat(C("source"), F.lit("\n"), F.substring("text", 1, 5000)))).alias("term"))
    freq = terms.groupBy("term").agg(F.count(F.lit(1)).alias("freq")).where("freq >= 4").withColumn("low", F.lower("term"))
    seeds = spark.createDataFrame([(s,) for s in SEEDS], "low string")
    best = freq.join(F.broadcast(seeds), "low", "left_anti").groupBy("low").agg(F.max_by("term", F.struct("freq", -F.ascii("term"), F.md5(C("term").cast("binary")))).alias("term"), F.max("freq").alias("freq"))
    return best.orderBy(C("freq").desc(), "low").limit(300).select("term", "freq")


def _sources(spark, sf_dir):
    kinds = F.array(*map(F.lit, [*K.SOURCE_WEIGHT, "other"]))
    return documents(spark, sf_dir).select(C("doc_id").alias("source_id"), F.element_at(kinds, (C("doc_id") % 9 + 1).cast("int")).alias("source_type"), (F.lit(1_700_000_000_000) + C("doc_id") * 60_000_000).alias("updated_ms"), C("text").alias("content"))


AS_OF = 1_707_000_000_000
_KINDS = [*K.SOURCE_WEIGHT, "other"]
_bracketed = lambda xs: f"([{q.listed(xs)}])"
_CHUNKS = f"""
l AS (SELECT doc_id, list_filter(list_transform(string_split({q.sanitize('text')}, chr(10)), lambda x: {q.strip('x')}), lambda x: x <> '') AS ls FROM documents),
r AS (SELECT doc_id, ls, 1 AS i, ls[1] AS now, []::VARCHAR[] AS done FROM l WHERE len(ls) > 0
  UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN length(now || chr(10) || ls[i + 1]) > {K.MAX_CHUNK_CHARS} THEN ls[i + 1] ELSE now || chr(10) || ls[i + 1] END, CASE WHEN length(now || chr(10) || ls[i + 1]) > {K.MAX_CHUNK_CHARS} THEN list_append(done, now) ELSE done END FROM r WHERE i < len(ls)),
e AS (SELECT doc_id, list_filter(list_append(done, now), lambda x: length(x) >= {K.MIN_CHUNK_CHARS})[1:{K.MAX_CHUNKS}] AS cs FROM r WHERE i = len(ls)),
ch AS MATERIALIZED (SELECT doc_id AS source_id, {_bracketed(_KINDS)}[doc_id % 9 + 1] AS source_type, (1700000000000 + doc_id * 60000000)::BIGINT AS updated_ms, unnest(range(len(cs)))::INT AS chunk_no, unnest(cs) AS chunk FROM e)"""
_tokens_sql = lambda c: f"list_distinct(list_filter(string_split({q.speech(q.sanitize(c))}, ' '), lambda x: length(x) > 1))"
_WEIGHTS = ", ".join(f"('{i}', '{k}', {K.SOURCE_WEIGHT.get(k, K.UNKNOWN_WEIGHT)}::DOUBLE * {by.get(k, 1.0)}::DOUBLE)" for i, by in K.INTENT_MULTIPLIER.items() for k in _KINDS)
#: Every chunk scored for every query qs (query_id, part, intent, query): tables need not be large here.
_SCORED = f"""
ct AS MATERIALIZED (SELECT *, {_tokens_sql('chunk')} AS ts, (1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({AS_OF} - updated_ms) / (86400000.0::DOUBLE * {K.FRESH_DAYS})))) * {K.FRESHNESS_WEIGHT}::DOUBLE AS age FROM ch),
wt AS (SELECT * FROM (VALUES {_WEIGHTS}) AS v(intent, source_type, base)), qt AS MATERIALIZED (SELECT *, {_tokens_sql('query')} AS toks FROM qs),
sc AS (SELECT qt.query_id, qt.part, qt.most, ct.source_id, ct.source_type, ct.chunk_no, ct.chunk, wt.base + (CASE WHEN len(toks) > 0 THEN len(list_intersect(toks, ts))::DOUBLE / len(toks) ELSE 0 END) * {K.LEXICAL_WEIGHT}::DOUBLE + ct.age AS score
  FROM qt JOIN ct ON qt.types IS NULL OR list_contains(qt.types, ct.source_type) JOIN wt ON wt.intent = qt.intent AND wt.source_type = ct.source_type),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, source_id, chunk_no) AS rank FROM sc QUALIFY rank <= most)"""
_INTENT = f"{_bracketed([*K.INTENT_MULTIPLIER])}[item_id % 3 + 1]"


@query(f"WITH RECURSIVE {_CHUNKS} SELECT source_id, chunk_no, md5(chunk) AS chunk_md5 FROM ch")
def chunks(spark, sf_dir):
    return ch.chunks(_sources(spark, sf_dir)).select("source_id", "chunk_no", F.md5(C("chunk").cast("binary")).alias("chunk_md5"))


def _asked(spark, sf_dir):
    """The benchmark's passages as queries."""
    intent = F.element_at(F.array(*map(F.lit, K.INTENT_MULTIPLIER)), (C("item_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("query"), intent.alias("intent"))


@query(f"WITH RECURSIVE {_CHUNKS}, qs AS (SELECT item_id AS query_id, 0 AS part, 5 AS most, NULL::VARCHAR[] AS types, {_INTENT} AS intent, text AS query FROM benchmark), {_SCORED} SELECT query_id, rank::INT AS rank, source_id, source_type, chunk_no, round(score, 4) AS score FROM rk")
def retrieve_topk(spark, sf_dir):
    return ch.retrieve(kept(ch.chunks(_sources(spark, sf_dir)), "chunks"), _asked(spark, sf_dir), limit=5, as_of_ms=AS_OF)


MANUAL = {"note": 1.6, "cv": 0.5}


@query(f"WITH RECURSIVE {_CHUNKS}, qs AS (SELECT item_id AS query_id, 0 AS part, 3 AS most, ['cv', 'note', 'github'] AS types, {_INTENT} AS intent, text AS query FROM benchmark), {_SCORED.replace('wt.base +', 'wt.base * (CASE wt.source_type ' + ' '.join(f'WHEN {q.quoted(k)} THEN {v}::DOUBLE' for k, v in MANUAL.items()) + ' ELSE 1.0::DOUBLE END) +')} SELECT query_id, rank::INT AS rank, source_id, source_type, chunk_no, round(score, 4) AS score FROM rk")
def retrieve_weighted(spark, sf_dir):
    """Of three allowed source types, with manual weights."""
    return ch.retrieve(kept(ch.chunks(_sources(spark, sf_dir)), "chunks"), _asked(spark, sf_dir), 3, AS_OF, ["cv", "note", "github"], MANUAL)


_PARTS = ", ".join(f"({q.quoted(name)}, {part}, {n}, {_bracketed(list(types))})" for name, two in ch.MIXES.items() for part, (n, types) in enumerate(two))


@query(f"""
WITH RECURSIVE {_CHUNKS}, mx AS (SELECT * FROM (VALUES {_PARTS}) AS v(mix, part, most, types)), qi AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 3 THEN 'always' ELSE {_INTENT} END AS mix, CASE WHEN item_id % 4 = 3 THEN 'mixed' ELSE {_INTENT} END AS intent, text AS query FROM benchmark),
qs AS (SELECT query_id, part, most, types, intent, query FROM qi JOIN mx USING (mix)), {_SCORED},
ln AS (SELECT query_id, part, rank, '[profile:' || source_type || '] ' || {q.clip('chunk', 220)} AS line FROM rk), un AS (SELECT * FROM ln WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(line)) ORDER BY part, rank) = 1),
to7 AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY part, rank) <= 7)
SELECT query_id, string_agg(line, chr(10) ORDER BY part, rank) AS context FROM to7 GROUP BY 1
""")
def retrieval_mix(spark, sf_dir):
    """Context of each passage: the best of the candidate's own sources and of the knowledge sources, as many of each as its intent and policy say."""
    asked = _asked(spark, sf_dir).withColumn("policy", F.when(C("query_id") % 4 == 3, "always").otherwise("auto"))
    return ch.context_mix(kept(ch.chunks(_sources(spark, sf_dir)), "chunks"), asked, AS_OF)


@query("SELECT source, lang, count(*)::BIGINT AS n, grouping(source)::INT AS all_sources, grouping(lang)::INT AS all_langs FROM documents GROUP BY ROLLUP (source, lang)")
def import_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").cast("int").alias("all_sources"), F.grouping("lang").cast("int").alias("all_langs"))
    return rows


@query(f"WITH {q.PAIRS} SELECT substr(sha1('sessions|' || {q.normalize('question')} || '|' || {q.normalize('answer')} || '|'), 1, 16) AS id, {q.classify_import('question', 'answer')} AS category, {q.detect_language('answer')} AS language FROM pairs WHERE {q.words('answer')} BETWEEN 20 AND 220")
def external_rows(spark, sf_dir):
    rows = pairs(spark, sf_dir).where(t.word_count(C("answer")).between(20, 220))
    ident = F.substring(F.sha1(F.concat(F.lit("sessions|"), t.normalize(C("question")), F.lit("|"), t.normalize(C("answer")), F.lit("|")).cast("binary")), 1, 16)
    return rows.select(ident.alias("id"), sc.classify_import(C("question"), C("answer")).alias("category"), sc.detect_language(C("answer")).alias("language"))
