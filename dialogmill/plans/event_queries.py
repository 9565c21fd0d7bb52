"""Queries over events: latency statistics, sessions, as-of matches, buffers, upserts, evaluation reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialogmill.functions import scoring as sc
from dialogmill.functions import text as t
from dialogmill.operators import pairs as op
from dialogmill.operators import percentiles as pc
from dialogmill.operators import scan
from dialogmill.operators import turns as tn
from dialogmill.plans import sql as q
from dialogmill.plans.base import documents, events, query, table

C = F.col
E = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


@query("""
WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n::BIGINT AS count, v[greatest(1, ceil(n * 0.5::DOUBLE)::BIGINT)] AS nearest_p50, v[greatest(1, ceil(n * 0.95::DOUBLE)::BIGINT)] AS nearest_p95,
  v[greatest(0, trunc(n * 0.5::DOUBLE - 1)::BIGINT) + 1] AS floor_p50, v[greatest(0, trunc(n * 0.95::DOUBLE - 1)::BIGINT) + 1] AS floor_p95, v[n // 2 + 1] AS upper_median FROM s
""")
def percentiles(spark, sf_dir):
    places = {"nearest_p50": pc.nearest_place(0.5), "nearest_p95": pc.nearest_place(0.95), "floor_p50": pc.floor_place(0.5), "floor_p95": pc.floor_place(0.95), "upper_median": pc.upper_place()}
    return pc.ranked_values(table(spark, sf_dir, "events"), ["event_type"], "value", places)


@query("SELECT event_type, arg_max(value, event_id) AS latest, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*)::BIGINT AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    some = pc.ranked_values(rows, ["event_type"], "value", {"p50": pc.nearest_place(0.5), "p95": pc.nearest_place(0.95)})
    return rows.groupBy("event_type").agg(F.max_by("value", "event_id").alias("latest"), F.round(F.avg("value"), 6).alias("mean")).join(some, "event_type")


@query("SELECT coalesce(CASE WHEN event_id % 100 < 10 THEN 'cold_start' ELSE 'warm_gate' END, '') AS bucket, event_type, count(*)::BIGINT AS count, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY 1, 2 UNION ALL SELECT 'all', event_type, count(*)::BIGINT, quantile_disc(value, 0.5) FROM events GROUP BY 2")
def cold_warm(spark, sf_dir):
    bucket = F.when(C("event_id") % 100 < 10, "cold_start").otherwise("warm_gate")
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.explode(F.array(bucket, F.lit("all"))).alias("bucket"))
    return pc.ranked_values(rows, ["bucket", "event_type"], "value", {"p50": pc.nearest_place(0.5)})


@query("""
WITH w AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)) AS v FROM events)
SELECT event_id, v[ceil(len(v) * 0.5::DOUBLE)::BIGINT] AS p50, v[ceil(len(v) * 0.95::DOUBLE)::BIGINT] AS p95, len(v)::INT AS n FROM w
""")
def rolling_percentiles(spark, sf_dir):
    """Over the last 300 values of a user."""
    return pc.rolling(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", {"p50": 0.5, "p95": 0.95}, 300)


@query(f"WITH {E} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3500000 PRECEDING AND CURRENT ROW), 6) AS level FROM e")
def rolling_level(spark, sf_dir):
    """The mean level of the last 3.5 s, as events are hours apart here, of 3500 s."""
    w = Window.partitionBy("user_id", "__piece").orderBy("ms").rangeBetween(-3_500_000, 0)
    rows = scan.in_time_pieces(events(spark, sf_dir).select("user_id", "event_id", "ms", "value"), ["user_id"], "ms", 3_500_000)
    return rows.withColumn("level", F.round(F.avg("value").over(w), 6)).where("NOT __halo").select("event_id", "level")


@query(f"""
WITH {E}, l AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= 7200000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM l)
SELECT user_id, session::BIGINT AS session, min(ms)::BIGINT AS first_ms, max(ms)::BIGINT AS last_ms, count(*)::BIGINT AS n FROM s GROUP BY 1, 2
""")
def gap_sessions(spark, sf_dir):
    rows = tn.gap_sessions(events(spark, sf_dir), ["user_id"], "ms", 7_200_000)
    return rows.groupBy("user_id", "session").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))


_SPEECH = "CASE event_type WHEN 'click' THEN 'remote' WHEN 'view' THEN 'self' ELSE 'diag' END"


@query(f"""
WITH {E}, r AS (SELECT event_id, user_id, ms, value, {_SPEECH} AS side FROM e),
a AS (SELECT *, last_value(CASE WHEN side = 'remote' THEN ms END IGNORE NULLS) OVER w AS remote_ms, last_value(CASE WHEN side = 'remote' THEN floor(value / 50) END IGNORE NULLS) OVER w AS remote_word,
  last_value(CASE WHEN side = 'diag' THEN ms END IGNORE NULLS) OVER w AS diag_ms, last_value(CASE WHEN side = 'diag' THEN value END IGNORE NULLS) OVER w AS diag_v FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, coalesce(abs(ms - remote_ms) <= 90000000 AND floor(value / 50) = remote_word AND abs(diag_ms - ms) <= 200000000 AND greatest(0, diag_v) <= greatest(160, greatest(0, 500 - diag_v) * 0.45::DOUBLE), false) AS echo FROM a WHERE side = 'self'
""")
def echo_asof(spark, sf_dir):
    """Clicks stand for remote speech, views for own speech, other events for levels; values for words. Events are hours apart here, so the windows are wide."""
    rows = events(spark, sf_dir).withColumn("side", F.expr(_SPEECH)).withColumn("word", F.floor(C("value") / 50))
    rows = rows.withColumn("self_rms", C("value")).withColumn("remote_rms", 500 - C("value"))
    rows = tn.as_of(rows, ["user_id"], "ms", {"remote": (C("side") == "remote", ["ms", "word"]), "diag": (C("side") == "diag", ["ms", "self_rms", "remote_rms"])})
    same = F.when(C("word") == C("remote.word"), 1.0).otherwise(0.0)
    return rows.where("side = 'self'").select("event_id", tn.echoes(same, 90_000_000, 0.86, 200_000_000).alias("echo"))


@query(f"WITH {E}, a AS (SELECT * FROM e WHERE event_id % 2 = 0), b AS (SELECT * FROM e WHERE event_id % 2 = 1) SELECT a.event_id, b.event_id AS right_id FROM a JOIN b ON a.user_id = b.user_id AND b.ms BETWEEN a.ms AND a.ms + 1800000")
def interval_hold(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "ms")
    return tn.within(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "ms", 1_800_000).select("event_id", "right_id")


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type <> 'click') AS value, arg_max(event_type, event_id) AS event_type, max(event_id)::BIGINT AS event_id FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(C("event_type") != "click", C("value")).alias("value"), "event_type")
    return tn.upsert(rows, ["user_id"], ["event_id"], ["value", "event_type", "event_id"])


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 12")
def history_buffer(spark, sf_dir):
    return tn.last_rows(table(spark, sf_dir, "events"), ["user_id"], [C("event_id").desc()], 12).select("user_id", "event_id")


@query(f"""
WITH n AS (SELECT * FROM conversations WHERE {q.strip("coalesce(text, '')")} <> ''), l AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS opens FROM n),
r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l)
SELECT conv_id, run::BIGINT AS run, role, count(*)::BIGINT AS n, min(turn)::BIGINT AS first, max(turn)::BIGINT AS last FROM r GROUP BY conv_id, run, role
""")
def turn_merge(spark, sf_dir):
    return op.merge_runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "run", "role", "n", "first", "last")


@query(f"""
WITH n AS (SELECT conv_id, turn, role, regexp_replace(trim(text), '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE {q.strip("coalesce(text, '')")} <> ''), l AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS opens FROM n),
r AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l), c AS (SELECT conv_id, run, role, count(*) AS k, any_value(text) AS text FROM r GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY run DESC) AS rn FROM c)
SELECT conv_id, run::BIGINT AS run, '[' || role || '] ' || {q.clip('text', 220)} AS line FROM t WHERE k = 1 AND rn <= CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END
""")
def context_lines(spark, sf_dir):
    runs = op.merge_runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    lines = op.context_lines(runs, ["conv_id"], "role", {"user": 2, "assistant": 1})
    return lines.join(runs.where("n = 1").select("conv_id", "run"), ["conv_id", "run"], "left_semi")


@query("""
SELECT c.conv_id, count(*)::BIGINT AS turns, count(*) FILTER (c.role = 'assistant')::BIGINT AS answers, count(*) FILTER (c.role = 'user')::BIGINT AS questions, count(l.doc_id) FILTER (l.quality = 1)::BIGINT AS chosen, count(l.doc_id) FILTER (l.quality = 0)::BIGINT AS rejected
FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id * 10 + c.turn GROUP BY 1
""")
def session_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "conversations").withColumn("doc_id", C("conv_id") * 10 + C("turn")).join(labels, "doc_id", "left")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(C("role") == "assistant").alias("answers"), F.count_if(C("role") == "user").alias("questions"), F.count_if(C("quality") == 1).alias("chosen"), F.count_if(C("quality") == 0).alias("rejected"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error')::BIGINT AS errors, count(*)::BIGINT AS n, round(count(*) FILTER (event_type = 'error')::DOUBLE / (count(*) FILTER (event_type = 'error') + count(*)), 4) AS error_rate FROM events GROUP BY 1")
def worker_error_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(C("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("error_rate", sc.error_rate(C("errors"), C("n")))


@query(f"SELECT conv_id, turn, first_value(CASE WHEN length(text) > 200 THEN {q.detect_language('text')} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lang FROM conversations")
def language_lock(spark, sf_dir):
    """The first language that a long enough turn tells sticks for its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.first(F.when(F.length("text") > 200, sc.detect_language(C("text"))), ignorenulls=True).over(w).alias("lang"))


@query(r"""SELECT conv_id, turn, CASE WHEN e >= 4200 THEN 0 ELSE greatest(120, least(CASE WHEN regexp_matches(text, '[.!?]["'')\]]?$') THEN 320 ELSE 1200 END, 4200 - e)) END::BIGINT AS delay FROM (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN text ELSE regexp_replace(text, '[.!?]$', '') END AS text, turn * 700 AS e FROM conversations)""")
def flush_delay(spark, sf_dir):
    """How long each turn would wait if it was the text of an open segment."""
    text = F.when(C("conv_id") % 2 == 0, C("text")).otherwise(F.regexp_replace("text", "[.!?]$", ""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tn.flush_delay(text, F.lit(0).cast("long"), C("turn") * 700).cast("long").alias("delay"))


def _sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(C("p_partkey").alias("id"), F.when(C("p_partkey") % 2 == 0, "llama-x").otherwise("qwen-y").alias("model"), (C("p_retailprice") / 4).alias("ttft"), (C("p_retailprice") * 1.5).alias("final"), (C("p_size") / 10.0).alias("quality"), (C("p_size") / 50.0).alias("grounding"))
    zero = F.lit(0.0)
    rows = rows.withColumn("family", t.model_family(C("model"))).withColumn("score", sc.weighted_score(C("ttft"), C("final"), C("quality"), C("grounding"), zero, zero, zero))
    return rows.withColumn("latency", sc.combined_latency(C("ttft"), C("final"))).withColumn("passed", (C("ttft") <= 380) & (C("final") <= 2000) & (C("quality") >= 1))


_SWEEP = """
p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'llama' ELSE 'qwen' END AS family, p_retailprice / 4 AS ttft, p_retailprice * 1.5::DOUBLE AS final, p_size / 10.0::DOUBLE AS quality, p_size / 50.0::DOUBLE AS grounding FROM part),
s AS (SELECT *, round(greatest(0, 5 - ttft / 300 - final / 1500) * 0.40::DOUBLE + quality * 0.35::DOUBLE + greatest(0, 5 * grounding) * 0.15::DOUBLE + 5 * 0.10::DOUBLE, 4) AS score, ttft + final AS latency, ttft <= 380 AND final <= 2000 AND quality >= 1 AS passed FROM p)"""


@query(f"WITH {_SWEEP} SELECT id, family, score, (row_number() OVER (PARTITION BY family ORDER BY score DESC, ttft, final, id))::INT AS rank FROM s QUALIFY rank <= 20")
def sweep_rank(spark, sf_dir):
    w = Window.partitionBy("family").orderBy(C("score").desc(), "ttft", "final", "id")
    return _sweep(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("id", "family", "score", "rank")


@query(f"""
WITH {_SWEEP}, b AS (SELECT family, arg_max(struct_pack(id := id, q := quality, l := latency), struct_pack(s := score, t := -ttft, f := -final, i := -id)) AS best FROM s WHERE passed GROUP BY 1),
c AS (SELECT max(best) FILTER (family = 'llama') AS a, max(best) FILTER (family = 'qwen') AS b FROM b)
SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a.q - b.q >= 0.3 AND greatest(0, (a.l - b.l) / b.l) <= 0.15 THEN a.id ELSE b.id END ELSE coalesce(a.id, b.id) END AS winner, (SELECT arg_min(id, struct_pack(t := ttft, f := final, i := id)) FROM s) AS fastest FROM c
""")
def sweep_recommendation(spark, sf_dir):
    rows = _sweep(spark, sf_dir)
    best = F.max_by(F.struct("id", "quality", "latency"), F.struct("score", -C("ttft"), -C("final"), -C("id")))
    of = lambda f: F.max_by(F.struct("id", "quality", "latency"), F.when(C("passed") & (C("family") == f), F.struct("score", -C("ttft"), -C("final"), -C("id")))).alias(f)
    one = rows.agg(of("llama"), of("qwen"), F.min_by("id", F.struct("ttft", "final", "id")).alias("fastest"))
    first = (C("llama.quality") - C("qwen.quality") >= 0.3) & (F.greatest(F.lit(0.0), (C("llama.latency") - C("qwen.latency")) / C("qwen.latency")) <= 0.15)
    winner = F.when(C("llama").isNotNull() & C("qwen").isNotNull(), F.when(first, C("llama.id")).otherwise(C("qwen.id"))).otherwise(F.coalesce("llama.id", "qwen.id"))
    return one.select(winner.alias("winner"), "fastest")


EXPECTED, STRATEGIC, AGAINST = ["the", "that", "latency", "ther"], ["because", "ther", "tradeoff"], ["never used", "theran"]
_hits = lambda words: f"list_filter([{q.listed(words)}], lambda x: contains(low, x))"
_EVALUATED = f"""
{q.PAIRS}, k0 AS (SELECT conv_id, turn, question, answer, lower({q.normalize('answer')}) AS low, {q.failure_tags('answer')} AS tags, {q.words('answer')} AS w, {q.overlap('question', 'answer')} AS ov, turn % 4 = 3 AS malformed FROM pairs),
k AS (SELECT *, {_hits(EXPECTED)} AS hits, {_hits(STRATEGIC)} AS strategic, {_hits(AGAINST)} AS against FROM k0),
ev AS (SELECT conv_id, turn, {q.first_person('answer')} AS first_person, (len(hits) > 0 OR ov >= 0.08) AS grounding_hit, round(len(hits) / {len(EXPECTED)}.0::DOUBLE, 4) AS keyword_hit_rate, len(against) > 0 AS contradiction, (len(against) > 0 OR malformed OR contains(tags, 'contains_code') OR contains(tags, 'ai_disclaimer')) AS hallucination, malformed,
  least(5.0::DOUBLE, greatest(1.0::DOUBLE, round({q.answer_hundredths('answer', 'question')} / 100.0::DOUBLE * 5 + (CASE WHEN len(hits) > 0 THEN 0.4::DOUBLE ELSE 0 END), 2))) AS quality,
  least(5.0::DOUBLE, greatest(1.0::DOUBLE, round(2.0::DOUBLE + 2.0::DOUBLE * len(strategic) / {len(STRATEGIC)} + (CASE WHEN contains(low, 'because') THEN 0.5::DOUBLE ELSE 0 END), 2))) AS strategic,
  least(5.0::DOUBLE, greatest(1.0::DOUBLE, 2.0::DOUBLE + (NOT contains(tags, 'not_first_person'))::INT + (w BETWEEN 35 AND 140)::INT + (len({q.sentences('answer')}) >= 2)::INT - (CASE WHEN tags <> '' THEN 0.5::DOUBLE ELSE 0 END))) AS naturalness FROM k)"""


def _evaluated(spark, sf_dir):
    """Answers of the conversations as a model's, with the question as their context; every fourth turn counts as malformed output."""
    from dialogmill.plans.base import pairs

    words = lambda x: F.array(*map(F.lit, x))
    return sc.evaluate(pairs(spark, sf_dir), words(EXPECTED), words(STRATEGIC), words(AGAINST), C("turn") % 4 == 3).select("conv_id", "turn", "first_person", "grounding_hit", "keyword_hit_rate", "contradiction", "hallucination", "malformed", "quality", "strategic", "naturalness")


@query(f"WITH {_EVALUATED} SELECT * FROM ev")
def prompt_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir)


RATES, MEANS = ["first_person", "grounding_hit", "contradiction", "hallucination", "malformed"], ["quality", "strategic", "naturalness"]
TARGETS = {"click": 300.0, "view": 200.0, "purchase": 260.0}
_GATE = [("stt_latency", f"click > {TARGETS['click']}"), ("ttft_latency", f"view > {TARGETS['view']}"), ("final_latency", f"purchase > {TARGETS['purchase']}"), ("malformed_output", "malformed > 0.02"), ("critical_hallucination", "hallucination >= 0.03"), ("persona_contradiction", "contradiction >= 0.05")]


@query(f"""
WITH {_EVALUATED}, su AS (SELECT count(*)::BIGINT AS count, {', '.join(f'round(coalesce(avg({c}::INT), 0), 4) AS {c}' for c in RATES)}, {', '.join(f'round(coalesce(avg({c}), 0), 4) AS {c}' for c in MEANS)} FROM ev),
lv AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1), lp AS (SELECT event_type, v[greatest(0, trunc(n * 0.5::DOUBLE - 1)::BIGINT) + 1] AS p50 FROM lv),
la AS (SELECT {', '.join(f"max(p50) FILTER (event_type = '{k}') AS {k}" for k in TARGETS)} FROM lp)
SELECT su.*, la.*, concat_ws(',', {', '.join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _GATE)}) AS blocked_reasons FROM su, la
""")
def benchmark_summary(spark, sf_dir):
    """Rates and means of the evaluated answers, medians of three latencies, and the reasons that block a release. Events stand for measurements."""
    from dialogmill.operators import records

    summary = sc.quality_summary(_evaluated(spark, sf_dir), RATES, MEANS)
    p50 = pc.ranked_values(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": pc.floor_place(0.5)})
    one = p50.agg(*[F.max(F.when(C("event_type") == k, C("p50"))).alias(k) for k in TARGETS])
    out = records.gate(summary.join(F.broadcast(one), F.lit(True)), [(n, F.expr(test)) for n, test in _GATE])
    return out.withColumn("blocked_reasons", F.array_join("blocked_reasons", ",")).drop("blocked")


@query("WITH c AS (SELECT sha1(text) AS k, max(quality)::VARCHAR AS cached FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 > 0 GROUP BY 1) SELECT doc_id, cached FROM documents d LEFT JOIN c ON c.k = sha1(d.text)")
def cache_lookup(spark, sf_dir):
    """Texts with what a cache by SHA-1 holds of them; misses stay null, copies of a text share a hit."""
    from dialogmill.sources.jsonl import cached

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = rows.where("doc_id % 3 > 0").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    known = known.groupBy(F.sha1(C("text").cast("binary")).alias("key")).agg(F.max("quality").cast("string").alias("value"))
    return cached(rows, known, "text").select("doc_id", "cached")


@query("WITH s AS (SELECT source AS type, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS name, doc_id % 50 AS moment, md5(text) AS content FROM documents) SELECT type, lower(name) AS name, arg_max(content, struct_pack(a := moment, c := content, n := name)) AS content FROM s GROUP BY 1, 2")
def replace_latest(spark, sf_dir):
    """Documents as sources: of one type and name, in whatever case, the last import counts."""
    from dialogmill.sources.sessions import replace_sources

    rows = table(spark, sf_dir, "documents").select(C("source").alias("type"), F.when(C("doc_id") % 2 == 0, F.upper("lang")).otherwise(C("lang")).alias("name"), (C("doc_id") % 50).alias("importedAtMs"), F.md5(C("text").cast("binary")).alias("content"))
    return replace_sources(rows).select("type", F.lower("name").alias("name"), "content")


@query("SELECT conv_id, turn, coalesce(l.quality = 1, false) AS chosen, coalesce(l.toxic, -1)::INT AS toxic FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id * 10 + c.turn")
def review_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, sf_dir, "conversations").withColumn("doc_id", C("conv_id") * 10 + C("turn")).join(labels, "doc_id", "left")
    return rows.select("conv_id", "turn", F.coalesce(C("quality") == 1, F.lit(False)).alias("chosen"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("SELECT event_id, (sqrt((a * a + b * b + c * c) / 3.0::DOUBLE)) AS rms FROM (SELECT event_id, floor(value * 60)::BIGINT AS a, -floor(value * 30)::BIGINT AS b, floor(value * 10)::BIGINT AS c FROM events)")
def rms_level(spark, sf_dir):
    """Levels of samples of 32 bits: sixty times a value may be beyond 16."""
    from dialogmill.functions.audio import pack_pcm32, rms

    v = [F.floor(C("value") * 60), -F.floor(C("value") * 30), F.floor(C("value") * 10)]
    samples = F.when(C("value").isNotNull(), F.array(*[x.cast("int") for x in v]))
    return table(spark, sf_dir, "events").select("event_id", rms(pack_pcm32(samples), 32).alias("rms"))
