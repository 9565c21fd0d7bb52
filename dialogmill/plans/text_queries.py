"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialogmill.functions import constants as K
from dialogmill.functions import scoring as sc
from dialogmill.functions import similarity as sim
from dialogmill.functions import text as t
from dialogmill.plans import sql as q
from dialogmill.plans.base import documents, pages, pairs, query, table

C = F.col


def md5(c):
    return F.md5(c.cast("binary"))


@query(f"SELECT doc_id, md5({q.normalize('text')}) AS norm_md5, md5({q.key('text')}) AS key_md5, length({q.normalize('text')})::INT AS n_norm FROM documents")
def text_normalize(spark, sf_dir):
    n = t.normalize(C("text"))
    return documents(spark, sf_dir).select("doc_id", md5(n).alias("norm_md5"), md5(t.key(C("text"))).alias("key_md5"), F.length(n).alias("n_norm"))


@query(f"SELECT doc_id, {q.words('text')}::INT AS words, len({q.sentences('text')})::INT AS sentences, md5(array_to_string({q.sentences('text')}, '|')) AS sentences_md5 FROM documents")
def word_sentence_counts(spark, sf_dir):
    s = t.sentences(C("text"))
    return documents(spark, sf_dir).select("doc_id", t.word_count(C("text")).alias("words"), F.size(s).alias("sentences"), md5(F.array_join(s, "|")).alias("sentences_md5"))


#: Answers with what the generated prose lacks: each form of failure, empty and null texts.
SAMPLES = [
    "I built the cache. It worked well!", "- one\n- two\n- three", "1. first\n2. second", "As an AI language model, I can't say.", "Here is code:\n```\nx = 1\n```\nDone.",
    "def run(x): pass", "Would you like more?", "The service scales. We've measured it.", "éi x", "xi yi", "  ", "", None, "My plan: use Kafka-2; it's fine", "class Foo(bar) {", "* star\n\n\n\nnot list\n• dot", "It's ours.\r\nReally?",
]


def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id int, text string")


SAMPLES_SQL = "samples AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if s is None else q.quoted(s).replace(chr(13), chr(39) + ' || chr(13) || ' + chr(39)).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))})" for i, s in enumerate(SAMPLES)) + ") AS v(id, text))"


@query(f"WITH {SAMPLES_SQL} SELECT id, {q.first_person('text')} AS first_person, {q.ai_disclaimer('text')} AS ai_disclaimer, {q.bullet_heavy('text')} AS bullet_heavy, {q.code_block('text')} AS code_block, {q.asks_back('text')} AS asks_back, {q.failure_tags('text')} AS tags, {q.punctuated('text')} AS punctuated FROM samples")
def answer_flags_samples(spark, sf_dir):
    x = C("text")
    return samples(spark).select("id", t.first_person(x).alias("first_person"), t.ai_disclaimer(x).alias("ai_disclaimer"), t.bullet_heavy(x).alias("bullet_heavy"), t.code_block(x).alias("code_block"), t.asks_back(x).alias("asks_back"), F.array_join(t.failure_tags(x), ",").alias("tags"), t.punctuated(x).alias("punctuated"))


@query(f"SELECT doc_id, {q.first_person('text')} AS first_person, {q.ai_disclaimer('text')} AS ai_disclaimer, {q.bullet_heavy('text')} AS bullet_heavy, {q.code_block('text')} AS code_block, {q.asks_back('text')} AS asks_back FROM documents")
def answer_flags(spark, sf_dir):
    x = C("text")
    return documents(spark, sf_dir).select("doc_id", t.first_person(x).alias("first_person"), t.ai_disclaimer(x).alias("ai_disclaimer"), t.bullet_heavy(x).alias("bullet_heavy"), t.code_block(x).alias("code_block"), t.asks_back(x).alias("asks_back"))


@query(f"WITH {q.PAIRS} SELECT conv_id, turn, {q.failure_tags('answer')} AS tags FROM pairs")
def failure_tags(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(t.failure_tags(C("answer")), ",").alias("tags"))


def _window_sql(text: str, most: int) -> str:
    """Relations s (numbered sentences) and cut (the longest prefix) for a relation src(id, x)."""
    return f"""
s AS (SELECT id, x, unnest({q.sentences('x')}) AS sent, unnest(range(len({q.sentences('x')}))) AS i FROM src),
run AS (SELECT id, i, sum({q.words('sent')}) OVER (PARTITION BY id ORDER BY i) AS upto, sent FROM s),
bad AS (SELECT id, min(i) AS stop FROM run WHERE upto > {most} GROUP BY id),
cut AS (SELECT run.id, string_agg(sent, ' ' ORDER BY i) AS kept FROM run LEFT JOIN bad USING (id) WHERE bad.stop IS NULL OR i < bad.stop GROUP BY run.id),
win AS (SELECT src.id, CASE WHEN {q.words('x')} <= {most} THEN {q.punctuated('x')} WHEN coalesce(kept, '') <> '' THEN {q.punctuated('kept')} ELSE {q.punctuated(f"array_to_string((regexp_split_to_array({q.normalize('x')}, '{chr(92)}s+'))[1:{most}], ' ')")} END AS trimmed FROM src LEFT JOIN cut USING (id))"""


@query(f"WITH src AS (SELECT doc_id AS id, text AS x FROM documents), {_window_sql('text', 140)} SELECT id AS doc_id, md5(trimmed) AS trimmed_md5, {q.words('trimmed')}::INT AS words FROM win")
def trim_window(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", t.word_window(C("text"), 140).alias("trimmed"))
    return rows.select("doc_id", md5(C("trimmed")).alias("trimmed_md5"), t.word_count(C("trimmed")).alias("words"))


def _lines_sql(lines: str) -> str:
    kept = f"list_filter(list_transform({lines}, lambda l: {q.normalize('l')}), lambda l: l <> '')[1:6]"
    return q.strip(f"substr({q.strip(f'''array_to_string({kept}, ' ')''')}, 1, 420)")


@query(f"SELECT doc_id, {_lines_sql('string_split(text, chr(10))')} AS summary FROM documents")
def summarize_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", t.summarize_lines(F.split("text", "\n", -1)).alias("summary"))


_DISCLAIM = rf"(?i){q.LEFT}({q.any_of(K.AI_DISCLAIMERS)})($|[^\p{{L}}\p{{N}}_])"


#: The spoken form g (id, x, r) of the answers of a relation raw (id, question, answer), one edit after another.
SPOKEN = f"""
a AS (SELECT id, CASE WHEN {q.normalize('answer')} = '' AND {q.normalize('question')} <> '' THEN {q.quoted(K.EMPTY_ANSWER[0])} || {q.normalize('question')} || {q.quoted(K.EMPTY_ANSWER[1])} ELSE {q.normalize('answer')} END AS x, {q.normalize('answer')} = '' AND {q.normalize('question')} <> '' AS r FROM raw),
b AS (SELECT id, CASE WHEN {q.bullet_heavy('x')} THEN {q.normalize(f"regexp_replace(x, '(?m)^{chr(92)}s*([-*•]|{chr(92)}d+{chr(92)}.){chr(92)}s+', '', 'g')")} ELSE x END AS x, r OR {q.bullet_heavy('x')} AS r FROM a),
c AS (SELECT id, CASE WHEN {q.code_block('x')} THEN {q.normalize("regexp_replace(x, '(?s)```.*?```', ' ', 'g')")} ELSE x END AS x, r OR {q.code_block('x')} AS r FROM b),
d AS (SELECT id, CASE WHEN {q.ai_disclaimer('x')} THEN {q.normalize(f"regexp_replace(regexp_replace(x, '{_DISCLAIM}', '{chr(92)}1{chr(92)}3', 'g'), '{_DISCLAIM}', '{chr(92)}1{chr(92)}3', 'g')")} ELSE x END AS x, r OR {q.ai_disclaimer('x')} AS r FROM c),
e AS (SELECT id, CASE WHEN x <> '' AND NOT {q.first_person('x')} THEN {q.quoted(K.FIRST_PERSON_PREFIX)} || lower(substr(x, 1, 1)) || substr(x, 2) ELSE x END AS x, r OR (x <> '' AND NOT {q.first_person('x')}) AS r FROM d),
src AS (SELECT * FROM e), {_window_sql('x', 140)},
f AS (SELECT e.id, CASE WHEN {q.asks_back('trimmed')} THEN {q.strip('substr(trimmed, 1, length(trimmed) - 1)')} || '.' ELSE trimmed END AS x, r OR {q.asks_back('trimmed')} AS r FROM e JOIN win USING (id)),
g AS (SELECT id, CASE WHEN {q.words('x')} < 45 THEN {q.punctuated(f"x || '  ' || {q.quoted(K.SHORT_ANSWER_EXTENSION)}")} ELSE {q.punctuated('x')} END AS x, r OR {q.words('x')} < 45 AS r FROM f)"""


@query(f"WITH {q.PAIRS}, {SAMPLES_SQL}, raw AS (SELECT 'p' || conv_id || '-' || turn AS id, question, answer FROM pairs UNION ALL SELECT 's' || id, 'How so?', text FROM samples), {SPOKEN} SELECT id, x AS spoken, r AS rewritten FROM g")
def speakable(spark, sf_dir):
    real = pairs(spark, sf_dir).select(F.concat(F.lit("p"), C("conv_id").cast("string"), F.lit("-"), C("turn").cast("string")).alias("id"), "question", "answer")
    made = samples(spark).select(F.concat(F.lit("s"), C("id").cast("string")).alias("id"), F.lit("How so?").alias("question"), C("text").alias("answer"))
    rows = real.unionByName(made).select("id", t.speakable(C("answer"), C("question")).alias("s"))
    return rows.select("id", C("s.text").alias("spoken"), C("s.rewritten").alias("rewritten"))


@query(f"SELECT doc_id, len({q.tokens('text')})::INT AS n_tokens, len({q.token_set('text')})::INT AS n_set, sha1(array_to_string(list_sort({q.token_set('text')}), ' ')) AS fingerprint, md5(substr(array_to_string(list_sort({q.tokens('text')}), '|'), 1, 1000)) AS qc_md5 FROM documents")
def token_sets(spark, sf_dir):
    # columns of their own, as what holds a lambda is computed at each place where it stands
    rows = documents(spark, sf_dir).select("doc_id", t.tokens(C("text")).alias("tokens"), t.token_set(C("text")).alias("set"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.size("set").alias("n_set"), t.fingerprint(C("set")).alias("fingerprint"), md5(t.qc_joined(C("tokens"))).alias("qc_md5"))


@query(f"SELECT conv_id, turn, md5({q.speech('text')}) AS speech_md5, md5({q.sanitize('text')}) AS sanitized_md5, {q.clip(q.sanitize('text'), 120)} AS clipped, md5({q.strip(f'''regexp_replace(coalesce(text, ''), '{chr(92)}s+', ' ', 'g')''')}) AS line_md5 FROM conversations")
def speech_normalize(spark, sf_dir):
    x = C("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", md5(t.speech(x)).alias("speech_md5"), md5(t.sanitize(x)).alias("sanitized_md5"), t.clip(t.sanitize(x), 120).alias("clipped"), md5(t.one_line(x)).alias("line_md5"))


MERGES = [("hello wor", "hello world"), ("micro-", "phone"), ("same", "same"), ("", "next"), ("base ", ""), ("one  two", "three"), ("longer text", "longer")]
_MERGES_SQL = "m AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q.quoted(a)}, {q.quoted(b)})" for i, (a, b) in enumerate(MERGES)) + ") AS v(id, a, b))"


@query(f"WITH {_MERGES_SQL} SELECT id, {q.merge('a', 'b')} AS merged FROM m")
def merge_text(spark, sf_dir):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(MERGES)], "id int, a string, b string").select("id", t.merge(C("a"), C("b")).alias("merged"))


@query(r"""
WITH w AS (SELECT event_id, '```json' || chr(10) || 'noise ' || props || ' tail' || chr(10) || '```' AS raw FROM events),
u AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)^```json', ''), '(?m)^```', '', 'g'), '(?m)```$', '', 'g'), '^\s+|\s+$', '', 'g') AS body FROM w)
SELECT event_id, body, nullif(regexp_extract(body, '(?s)\{.*\}'), '') AS object, (nullif(regexp_extract(body, '(?s)\{.*\}'), '')::JSON ->> 'k')::BIGINT AS k FROM u
""")
def json_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("```json\nnoise "), C("props"), F.lit(" tail\n```")).alias("raw"))
    rows = rows.select("event_id", t.unfence(C("raw")).alias("body")).withColumn("object", t.json_object(C("body")))
    return rows.select("event_id", "body", "object", F.from_json("object", "k BIGINT")["k"].alias("k"))


@query(r"""
SELECT p_partkey, replace(p_name || ' | ' || p_type, '|', '\|') AS cell, substr(regexp_replace(p_name, '[^a-zA-Z0-9_-]', '', 'g'), 1, 16) AS file_name,
  coalesce(try_cast(p_size::VARCHAR AS DOUBLE), 0.0) AS size_number, coalesce(try_cast(p_brand AS DOUBLE), -1.0) AS brand_number,
  CASE WHEN contains(lower(p_type), 'llama') THEN 'llama' WHEN contains(lower(p_type), 'qwen') THEN 'qwen' ELSE 'other' END AS family,
  trim(split_part(p_brand || ':' || p_type, ':', 1)) AS stt, trim(split_part(p_brand || ':' || p_type, ':', 2)) AS assist FROM part
""")
def string_utils(spark, sf_dir):
    c = t.combo(F.concat(C("p_brand"), F.lit(":"), C("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", t.markdown_cell(F.concat(C("p_name"), F.lit(" | "), C("p_type"))).alias("cell"), t.file_name(C("p_name")).alias("file_name"), t.number(C("p_size")).alias("size_number"), t.number(C("p_brand"), -1.0).alias("brand_number"), t.model_family(C("p_type")).alias("family"), c["stt"].alias("stt"), c["assist"].alias("assist"))


_PARTS = f"list_filter(list_transform(string_split(replace({q.normalize('text')}, chr(10), ' '), '. '), lambda s: {q.strip('s')}), lambda s: s <> '')[1:4]"


@query(f"SELECT doc_id, source || '. ' || CASE WHEN {q.strip(f'''array_to_string({_PARTS}, '. ')''')} = '' THEN substr({q.normalize('text')}, 1, 720) ELSE {q.strip(f'''array_to_string({_PARTS}, '. ')''')} END AS summary FROM documents")
def corpus_summary(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", t.corpus_summary(C("text"), C("source")).alias("summary"))


@query(f"""
WITH {q.PAIRS} SELECT conv_id, turn, {q.overlap('question', 'answer')} AS overlap, {q.jaccard(q.token_set('question'), q.token_set('answer'))} AS jaccard,
  CASE WHEN {q.normalize('question')} = '' THEN 1.0::DOUBLE ELSE {q.overlap('question', 'answer')} END AS grounded,
  {q.jaccard(f"list_distinct(list_filter(string_split({q.speech('question')}, ' '), lambda x: x <> ''))", f"list_distinct(list_filter(string_split({q.speech('answer')}, ' '), lambda x: x <> ''))")} AS speech_jaccard FROM pairs
""")
def pair_similarity(spark, sf_dir):
    a, b = C("question"), C("answer")
    return pairs(spark, sf_dir).select("conv_id", "turn", sim.overlap(a, b).alias("overlap"), sim.jaccard(t.token_set(a), t.token_set(b)).alias("jaccard"), sim.groundedness(b, a).alias("grounded"), sim.jaccard(sim.speech_tokens(a), sim.speech_tokens(b)).alias("speech_jaccard"))


@query("""
WITH i AS (SELECT user_id, event_id, event_type FROM events), u AS (SELECT user_id, lower(trim(event_type)) AS k, min(event_id) AS first_id, arg_min(event_type, event_id) AS item FROM i GROUP BY ALL)
SELECT user_id, array_to_string((list(item ORDER BY first_id))[1:7], ',') AS items FROM u GROUP BY user_id
""")
def combine_unique(spark, sf_dir):
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    rows = firsts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("items"))
    return rows.select("user_id", F.array_join(sim.combine_unique(C("items")), ",").alias("items"))


@query(f"SELECT doc_id, {q.detect_language('text')} AS detected FROM documents")
def detect_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", sc.detect_language(C("text")).alias("detected"))


def _noise_sql(c: str) -> str:
    lines = rf"list_filter(list_transform(regexp_split_to_array({c}, '\r\n|\n|\r'), lambda l: {q.strip('l')}), lambda l: l <> '')"
    short = f"len(list_filter(lines, lambda l: length(l) < 40))::DOUBLE / len(lines)"
    return lines, f"CASE WHEN len(lines) = 0 THEN true ELSE ({q.contains_count(f'lower({c})', K.NOISE_MARKERS)} >= 4 AND {short} >= 0.6) OR (length({c}) < 2200 AND {short} >= 0.72 AND len(list_distinct(lines))::DOUBLE / len(lines) <= 0.42) END"


@query(f"WITH h AS MATERIALIZED (SELECT page_id, {q.html_text('html')} AS body FROM pages), l AS (SELECT page_id, body, {_noise_sql('body')[0]} AS lines FROM h) SELECT page_id, {_noise_sql('body')[1]} AS noise, len(lines)::INT AS n_lines FROM l")
def noise_filter(spark, sf_dir):
    from dialogmill.functions import web

    rows = pages(spark, sf_dir, "page_id", "html").select("page_id", web.html_text(C("html")).alias("body"))
    lines = F.filter(F.transform(F.split("body", r"\r\n|\n|\r", -1), t.strip), lambda x: x != "")
    return rows.select("page_id", sc.noise(C("body")).alias("noise"), F.size(lines).alias("n_lines"))


def web_quality_sql(c: str, title: str) -> str:
    cap = lambda x, m: f"least(({x})::DOUBLE / {m}, 1.0::DOUBLE)"
    words = rf"regexp_extract_all(lower({c}), '[A-Za-z0-9_\-À-ɏ]+')"
    tech = f"len(list_filter({words}, lambda w: w IN ({q.listed(K.TECH_HINTS)})))"
    asks = rf"len(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ({q.listed(K.QUESTION_HINTS)})))"
    braces = lambda b: f"length({c}) - length(replace({c}, '{b}', ''))"
    total = f"{cap(f'len({words})', 1600)} * 0.3::DOUBLE + len(list_distinct({words}))::DOUBLE / len({words}) * 0.2::DOUBLE + {cap(tech, 22)} * 0.3::DOUBLE + {cap(asks, 12)} * 0.1::DOUBLE + {cap(f'''len(regexp_extract_all({c}, '[^.!?]+[.!?]+'))''', 40)} * 0.1::DOUBLE - (CASE WHEN {braces('{')} > 14 OR {braces('}')} > 14 THEN 0.05::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower({title}), 'interview') THEN 0.03::DOUBLE ELSE 0 END)"
    return f"(CASE WHEN len({words}) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {total})) END)"


@query(f"SELECT doc_id, round({web_quality_sql('text', 'source')}, 6) AS quality FROM documents")
def web_quality(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", F.round(sc.web_quality(C("text"), C("source")), 6).alias("quality"))


@query(f"WITH {q.PAIRS} SELECT conv_id, turn, {q.answer_hundredths('answer', 'question')}::INT AS hundredths, {q.keep_answer('answer')} AS keep FROM pairs")
def answer_quality(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", sc.answer_hundredths(C("answer"), C("question")).alias("hundredths"), sc.keep_answer(C("answer")).alias("keep"))


def _import_quality_sql(qn: str, a: str, cat: str) -> str:
    low = f"lower({qn} || chr(10) || {a})"
    fixed = f"(20 + (CASE WHEN contains({qn}, '?') THEN 10 ELSE 0 END) + (CASE WHEN {cat} IN ('nlp_and_llm', 'mlops_infra', 'behavioral_interview') THEN 10 ELSE 0 END) + (CASE WHEN length({a}) > 120 THEN 5 ELSE 0 END))"
    return f"least(0.95::DOUBLE, {fixed} / 100.0::DOUBLE + least({q.words(a)} / 180.0::DOUBLE, 1.0::DOUBLE) * 0.35::DOUBLE + least({q.contains_count(low, sc.import_terms())} / 4.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE)"


@query(f"""
WITH {q.PAIRS}, c AS (SELECT *, {q.classify_import('question', 'answer')} AS category FROM pairs)
SELECT conv_id, turn, category, round({_import_quality_sql('question', 'answer', 'category')}, 4) AS quality,
  ({q.normalize('answer')} <> '' AND length({q.normalize('question')}) >= 12 AND {q.words(q.normalize('answer'))} BETWEEN 20 AND 220 AND regexp_matches(lower({q.normalize('question')} || chr(10) || {q.normalize('answer')}), '{q.any_of(sc.import_terms())}')) AS keep FROM c
""")
def import_quality(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("category", sc.classify_import(C("question"), C("answer")))
    return rows.select("conv_id", "turn", "category", sc.import_quality(C("question"), C("answer"), C("category")).alias("quality"), sc.keep_import(C("question"), C("answer"), 20, 220).alias("keep"))


@query(f"WITH {q.PAIRS} SELECT conv_id, turn, {q.classify('question', 'answer')} AS category, {q.classify_import('question', 'answer')} AS import_category FROM pairs")
def category_classify(spark, sf_dir):
    a, b = C("question"), C("answer")
    return pairs(spark, sf_dir).select("conv_id", "turn", sc.classify(a, b).alias("category"), sc.classify_import(a, b).alias("import_category"))


@query(f"SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (value / 490.0::DOUBLE >= 0.82)::BIGINT AS high, count(*) FILTER (value / 490.0::DOUBLE >= 0.58 AND value / 490.0::DOUBLE < 0.82)::BIGINT AS medium FROM events GROUP BY 1")
def confidence_bands(spark, sf_dir):
    band = sc.confidence_band(sc.confidence(C("value") / 490.0))
    rows = table(spark, sf_dir, "events").select("event_type", band.alias("band"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("band") == "high").alias("high"), F.count_if(C("band") == "medium").alias("medium"))


_LIVE = f"""concat_ws(',', CASE WHEN NOT {q.has_word("text", K.LIVE_FIRST_PERSON)} THEN 'not_first_person' END, CASE WHEN len(regexp_split_to_array(coalesce(text, ''), '{chr(92)}s+')) < 35 THEN 'too_short' END, CASE WHEN length(coalesce(text, '')) > 900 THEN 'too_long' END)"""


@query(f"SELECT conv_id, turn, {_LIVE} AS flags FROM conversations WHERE role = 'assistant'")
def live_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(sc.live_flags(C("text"), F.lit(None).cast("array<string>")), ",").alias("flags"))


ASKED = [
    "Tell me about your experience with Kubernetes", "What is a transformer?", "How was your day?", "Walk me through your background", "Explain the difference between REST and gRPC in your experience",
    "Anything else?", "", None, "Gunun nasil gecti?", "How does a cache work", "you built this project on github", "Describe a typical day", "Compare BERT and GPT", "my project",
]
_ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if s is None else q.quoted(s)})" for i, s in enumerate(ASKED)) + ") AS v(id, text))"


@query(f"""
WITH {_ASKED_SQL}, f AS (SELECT 'a' || id AS id, {q.flavor('text')} AS flavor FROM asked UNION ALL SELECT 'c' || conv_id || '-' || turn, {q.flavor('text')} FROM conversations WHERE role = 'user'),
i AS (SELECT id, flavor, CASE WHEN flavor = 'personal_daily' THEN 'candidate_specific' ELSE flavor END AS intent FROM f)
SELECT id, flavor, intent, policy, CASE WHEN policy = 'profile_only' THEN 'profile_only' WHEN policy = 'general_then_profile' THEN 'general_first' WHEN intent = 'candidate_specific' THEN 'profile_first' WHEN intent = 'technical_general' THEN 'general_first' ELSE 'balanced' END AS mode
FROM i, (VALUES ('adaptive'), ('profile_only'), ('general_then_profile')) AS p(policy)
""")
def question_intent(spark, sf_dir):
    made = spark.createDataFrame(list(enumerate(ASKED)), "id int, text string").select(F.concat(F.lit("a"), C("id").cast("string")).alias("id"), "text")
    real = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat(F.lit("c"), C("conv_id").cast("string"), F.lit("-"), C("turn").cast("string")).alias("id"), "text")
    rows = made.unionByName(real).select("id", sc.question_flavor(C("text")).alias("flavor"), sc.intent(C("text")).alias("intent"))
    rows = rows.withColumn("policy", F.explode(F.array(*map(F.lit, ["adaptive", "profile_only", "general_then_profile"]))))
    return rows.withColumn("mode", sc.answer_mode(C("intent"), C("policy")))


@query(f"""
WITH {q.PAIRS}, s AS (SELECT conv_id, turn, answer, {q.answer_hundredths('answer', 'question')} / 100.0::DOUBLE AS quality, turn % 3 = 0 AS specific, len(string_split({q.failure_tags('answer')}, ',')) AS n_tags, {q.failure_tags('answer')} AS tags FROM pairs),
f AS (SELECT *, CASE WHEN tags = '' THEN 0 ELSE n_tags END AS failures FROM s),
g AS (SELECT conv_id, turn, CASE WHEN quality >= 0.8 THEN 5 WHEN quality >= 0.65 THEN 4 WHEN quality >= 0.5 THEN 3 ELSE 2 END AS correctness,
  CASE WHEN specific AND quality < 0.6 THEN least(least(5, greatest(1, round_even(quality * 5, 0)::INT)), 3) ELSE least(5, greatest(1, round_even(quality * 5, 0)::INT)) END AS groundedness,
  CASE WHEN failures = 0 THEN 5 ELSE greatest(1, 5 - failures) END AS speakability, CASE WHEN {q.first_person('answer')} AND NOT ends_with(answer, '?') THEN 5 ELSE 3 END AS copilot_tone,
  CASE WHEN len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) BETWEEN 45 AND 140 THEN 5 ELSE 3 END AS concision, failures FROM f)
SELECT conv_id, turn, correctness::INT AS correctness, groundedness::INT AS groundedness, speakability::INT AS speakability, copilot_tone::INT AS copilot_tone, concision::INT AS concision,
  (correctness + groundedness + speakability + copilot_tone + concision) / 5.0::DOUBLE AS average,
  correctness + groundedness + speakability + copilot_tone + concision >= 21 AND least(correctness, groundedness, speakability) >= 4 AND failures = 0 AS passed FROM g
""")
def judge(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("conv_id", "turn", "answer", (sc.answer_hundredths(C("answer"), C("question")) / 100.0).alias("quality"))
    rows = rows.withColumn("j", sc.rule_judge(C("answer"), C("quality"), C("turn") % 3 == 0))
    return rows.select("conv_id", "turn", "j.*")
