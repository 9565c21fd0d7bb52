"""Queries of the live session and of what surrounds it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialogmill.functions import live as fl
from dialogmill.functions import scoring as sc
from dialogmill.functions import text as t
from dialogmill.plans import sql as q
from dialogmill.plans import text_queries as tq
from dialogmill.plans.base import SQL, events, query, table
from dialogmill.streaming import live, stateful
from dialogmill.streaming.events import read
from dialogmill.streaming.run import available_now

C = F.col


#: The pause that ends a session, where a fold has one.
REST_MS = 6000
_SESSION_ROWS = f"""
rows_ AS (SELECT *, sum(CASE WHEN ms - p <= {REST_MS} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS p FROM (
  SELECT user_id, (epoch_us(ts) // 1000) // 20000 AS ms, event_id, CASE WHEN event_id % 41 = 40 THEN 'muted' ELSE (['remote', 'self', 'diag'])[event_id % 3 + 1] END AS kind,
    'word' || floor(value / 100)::BIGINT || (CASE WHEN event_id % 4 = 0 THEN '.' ELSE ' and' END) AS text, value AS level, 500 - value AS other, floor(value * 2)::BIGINT AS work, value / 500 AS confidence FROM events))),
clock AS (SELECT (epoch_us(max(ts)) // 1000 - 600000) // 20000 AS t FROM events)"""
_ROWS = "STRUCT(ms BIGINT, what VARCHAR, event_id BIGINT, text VARCHAR, score DOUBLE)[]"
_put = lambda ms, what, event_id, text, score="NULL::DOUBLE": f"[{{'ms': {ms}, 'what': {what}, 'event_id': {event_id}, 'text': {text}, 'score': {score}}}]"


def _fold_sql(start: str, steps: list[str], state: str, streamed: bool = False, key: str = "user_id", of_key: str = "user_id", only: str = "true", tick: bool = True) -> str:
    """A fold over the events of each ``key``: the state starts as ``start``; each of ``steps`` is a list of columns over the one before, the first over the
    state and the event; ``state`` names the columns that go on. Every step appends to ``o``, the rows that are emitted. A stream ends before its watermark, which is every key's last event, of kind tick."""
    body = f"SELECT st.k, st.i + 1 AS i, {', '.join(f'st.{c.strip()}' for c in state.split(','))}, se.ms, se.event_id, se.kind, se.text, se.level, se.other, se.work, se.confidence, se.session, []::{_ROWS} AS o FROM st JOIN se ON se.k = st.k AND se.i = st.i + 1"
    for columns in steps:
        body = f"SELECT * REPLACE ({columns}) FROM ({body})"
    source = f"SELECT {key} AS k, ms, event_id, kind, text, level, other, work, confidence, session FROM rows_, clock WHERE {only} AND {'ms < t' if streamed else 'true'}"
    ticks = f" UNION ALL SELECT DISTINCT k, t - 1, NULL, 'tick', '', 0, 0, 0, 0, NULL FROM ({source}), clock" if streamed and tick else ""
    return f"""WITH RECURSIVE {_SESSION_ROWS}, se AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, event_id NULLS LAST) AS i FROM ({source}{ticks})),
  st AS (SELECT k, 0::BIGINT AS i, {start}, []::{_ROWS} AS o FROM (SELECT DISTINCT k FROM se)
  UNION ALL SELECT k, i, {state}, o FROM ({body})), u AS (SELECT k, unnest(o) AS r FROM st) SELECT {of_key.replace('user_id', 'k')} AS user_id, r.ms AS ms, r.what AS what, r.event_id AS event_id, r.text AS text, round(r.score, 6) AS score FROM u"""


_EVENT = "{'ms': ms, 'event_id': event_id, 'text': text}"
_HELD = "STRUCT(ms BIGINT, event_id BIGINT, text VARCHAR)"
_words = lambda c: f"list_distinct(list_filter(string_split({q.speech(c)}, ' '), lambda x: x <> ''))"
_echo = lambda ms, text, far: f"coalesce(length({q.speech(text)}) < 3 OR ({far} IS NOT NULL AND diag IS NOT NULL AND abs({ms} - {far}.ms) <= 1400 AND {q.jaccard(_words(text), _words(far + '.text'))} >= 0.9 AND abs(diag.ms - {ms}) <= 2000 AND greatest(0.0, diag.own) <= greatest(160.0, greatest(0.0, diag.far) * 0.45::DOUBLE)), false)"
_ECHO = lambda streamed: _fold_sql(
    f"NULL::{_HELD} AS held, NULL::{_HELD} AS remote, NULL::STRUCT(ms BIGINT, own DOUBLE, far DOUBLE) AS diag",
    [
        f"CASE WHEN held.ms + 650 <= ms THEN o || {_put('held.ms', chr(39) + 'self' + chr(39), 'held.event_id', 'held.text')} ELSE o END AS o, CASE WHEN held.ms + 650 <= ms THEN NULL ELSE held END AS held",
        f"""CASE WHEN kind = 'diag' THEN {{'ms': ms, 'own': level, 'far': other}} ELSE diag END AS diag, CASE WHEN kind = 'remote' THEN {_EVENT} ELSE remote END AS remote,
        CASE WHEN kind = 'self' THEN (CASE WHEN {_echo('ms', 'text', 'remote')} THEN o || {_put('ms', "'dropped'", 'event_id', 'text')} WHEN held IS NOT NULL THEN o || {_put('held.ms', "'self'", 'held.event_id', 'held.text')} ELSE o END)
          WHEN kind = 'remote' THEN (CASE WHEN held IS NULL THEN o WHEN {_echo('held.ms', 'held.text', _EVENT)} THEN o || {_put('held.ms', "'dropped'", 'held.event_id', 'held.text')} WHEN held.ms <= ms THEN o || {_put('held.ms', "'self'", 'held.event_id', 'held.text')} ELSE o END) || {_put('ms', "'remote'", 'event_id', 'text')} ELSE o END AS o,
        CASE WHEN kind = 'self' THEN (CASE WHEN {_echo('ms', 'text', 'remote')} THEN held ELSE {_EVENT} END) WHEN kind = 'remote' AND held IS NOT NULL AND ({_echo('held.ms', 'held.text', _EVENT)} OR held.ms <= ms) THEN NULL ELSE held END AS held""",
    ],
    "held, remote, diag",
    streamed,
)
_SEGMENT = "STRUCT(text VARCHAR, started BIGINT, updated BIGINT, event_id BIGINT, confidence DOUBLE)"
_fire = _put("seg.updated", "'segment'", "seg.event_id", "seg.text", "seg.confidence")
_left = "(4200 - (seg.updated - seg.started))"
_due = rf"""(CASE WHEN {_left} <= 0 THEN seg.updated ELSE seg.updated + greatest(120, least(CASE WHEN regexp_matches(seg.text, '[.!?]["'')\]]?$') THEN 320 ELSE 1200 END, {_left})) END)"""
_SEGMENTS = lambda streamed: _fold_sql(
    f"NULL::{_SEGMENT} AS seg",
    [
        f"CASE WHEN {_due} <= ms THEN o || {_fire} ELSE o END AS o, CASE WHEN {_due} <= ms THEN NULL ELSE seg END AS seg",
        f"CASE WHEN kind = 'remote' AND ms - seg.updated > 2200 THEN o || {_fire} ELSE o END AS o, CASE WHEN kind = 'remote' AND ms - seg.updated > 2200 THEN NULL ELSE seg END AS seg",
        f"CASE WHEN kind <> 'remote' THEN seg WHEN seg IS NULL THEN {{'text': trim(text), 'started': ms, 'updated': ms, 'event_id': event_id, 'confidence': confidence}} ELSE {{'text': {q.merge('seg.text', 'text')}, 'started': seg.started, 'updated': ms, 'event_id': event_id, 'confidence': greatest(0.0, least(1.0, (seg.confidence + confidence) / 2))}} END AS seg",
    ],
    "seg",
    streamed,
)
_pop = f"CASE WHEN len(line) > 0 AND busy <= ms THEN o || {_put('busy', chr(39) + 'served' + chr(39), 'line[1].event_id', 'line[1].text')} ELSE o END AS o, CASE WHEN len(line) > 0 AND busy <= ms THEN busy + line[1].work ELSE busy END AS busy, CASE WHEN len(line) > 0 AND busy <= ms THEN line[2:] ELSE line END AS line"
_QUEUE = lambda streamed: _fold_sql(
    "0::BIGINT AS busy, []::STRUCT(event_id BIGINT, work BIGINT, text VARCHAR)[] AS line",
    [
        _pop, _pop,
        f"""CASE WHEN kind = 'tick' THEN o WHEN kind = 'muted' THEN o || list_transform(line, lambda x: {_put('ms', "'cleared'", 'x.event_id', 'x.text')}[1]) WHEN busy <= ms THEN o || {_put('ms', "'served'", 'event_id', 'text')} WHEN len(line) >= 2 THEN o || {_put('ms', "'dropped'", 'line[1].event_id', 'line[1].text')} ELSE o END AS o,
        CASE WHEN kind NOT IN ('muted', 'tick') AND busy <= ms THEN ms + work ELSE busy END AS busy,
        CASE WHEN kind = 'tick' THEN line WHEN kind = 'muted' THEN line[1:0] WHEN busy <= ms THEN line WHEN len(line) >= 2 THEN list_append(line[2:], {{'event_id': event_id, 'work': work, 'text': text}}) ELSE list_append(line, {{'event_id': event_id, 'work': work, 'text': text}}) END AS line""",
    ],
    "busy, line",
    streamed,
)
_switch = "(ms - heard >= 4000 AND ms - coalesce(switched, -1000000000000000) >= 8000 AND other >= greatest(110.0, level * 1.35::DOUBLE))"
_HEALTH = lambda streamed: _fold_sql(
    "NULL::BIGINT AS heard, NULL::BIGINT AS switched, false AS suspect, NULL::HUGEINT AS own",
    [
        "CASE WHEN own = session THEN heard END AS heard, CASE WHEN own = session THEN switched END AS switched, CASE WHEN own = session THEN suspect ELSE false END AS suspect, session AS own",
        "CASE WHEN level >= 70 THEN ms ELSE coalesce(heard, ms) END AS heard",
        f"""CASE WHEN {_switch} THEN o || {_put('ms', "'switch'", 'event_id', "''")} WHEN (ms - heard >= 4000) <> suspect THEN o || {_put('ms', "(CASE WHEN suspect THEN 'healthy' ELSE 'suspect' END)", 'event_id', "''")} ELSE o END AS o,
        CASE WHEN {_switch} THEN ms ELSE switched END AS switched, CASE WHEN {_switch} THEN suspect ELSE ms - heard >= 4000 END AS suspect, CASE WHEN {_switch} THEN ms ELSE heard END AS heard""",
    ],
    "heard, switched, suspect, own",
    streamed,
    tick=False,
)
_ready = "(CASE WHEN n >= 2 THEN ((greatest(voice + 540, updated) + 79) // 80) * 80 END)"
_voiced = "(level >= CASE kind WHEN 'remote' THEN 100 ELSE 50 END)"
_side = "(CASE WHEN k % 2 = 1 THEN 'self' ELSE 'remote' END)"
#: Speakers don't meet, so each speaker of a user is a key.
_UTTERANCES = lambda streamed: _fold_sql(
    "0::BIGINT AS n, 0::BIGINT AS first, 0::BIGINT AS voice, 0::BIGINT AS updated, 0::BIGINT AS dropped, '' AS audio, NULL::HUGEINT AS own",
    [
        f"CASE WHEN {_ready} <= ms THEN o || {_put(_ready, _side, 'first', 'audio', 'dropped::DOUBLE')} ELSE o END AS o, CASE WHEN {_ready} <= ms THEN 0 ELSE n END AS n, CASE WHEN {_ready} <= ms THEN 0 ELSE dropped END AS dropped",
        "CASE WHEN own = session THEN n ELSE 0 END AS n, CASE WHEN own = session THEN dropped ELSE 0 END AS dropped, session AS own",
        f"CASE WHEN n > 0 THEN first ELSE event_id END AS first, CASE WHEN n > 0 THEN audio || ' ' || event_id ELSE event_id::VARCHAR END AS audio, CASE WHEN {_voiced} THEN ms ELSE voice END AS voice, ms AS updated, CASE WHEN {_voiced} OR n > 0 THEN dropped ELSE dropped + 1 END AS dropped, CASE WHEN {_voiced} OR n > 0 THEN n + 1 ELSE 0 END AS n",
    ],
    "n, first, voice, updated, dropped, audio, own",
    streamed,
    "user_id * 2 + (kind = 'self')::INT",
    "user_id // 2",
    "kind IN ('remote', 'self')",
)
_THROTTLE = _fold_sql("NULL::BIGINT AS passed", [f"""CASE WHEN coalesce(ms - passed >= 2500, true) THEN o || {_put('ms', "'passed'", 'event_id', "''")} ELSE o END AS o, CASE WHEN coalesce(ms - passed >= 2500, true) THEN ms ELSE passed END AS passed"""], "passed")


def _replayed(spark, sf_dir, fold):
    return live.replay(live.session_events(events(spark, sf_dir)), fold).withColumn("score", F.round("score", 6))


@query(_ECHO(False))
def live_echo_hold(spark, sf_dir):
    return _replayed(spark, sf_dir, live.EchoHold())


@query(_SEGMENTS(False))
def live_segments(spark, sf_dir):
    return _replayed(spark, sf_dir, live.Segments())


@query(_QUEUE(False))
def live_queue(spark, sf_dir):
    return _replayed(spark, sf_dir, live.Queue())


@query(_HEALTH(False))
def live_source_health(spark, sf_dir):
    return _replayed(spark, sf_dir, live.SourceHealth(rest_ms=REST_MS))


@query(_THROTTLE)
def diagnostics_throttle(spark, sf_dir):
    return _replayed(spark, sf_dir, live.Throttle(2500))


#: The voice level of each side.
THRESHOLDS = {"remote": 100.0, "self": 50.0}


def _streamed(spark, sf_dir, fold):
    """The events as a stream of live sessions, to its end: a fold's rows up to the watermark."""
    rows = available_now(read(spark, sf_dir), lambda s: stateful.stream(live.session_events(s), fold, live.SCALE), "append", stateful.ROCKSDB)
    return rows.withColumn("score", F.round("score", 6))


@query(_UTTERANCES(True))
def stream_utterances(spark, sf_dir):
    """Voice-activity buffers of each speaker."""
    return _streamed(spark, sf_dir, live.Utterances(THRESHOLDS, rest_ms=REST_MS))


@query(_ECHO(True))
def stream_echo_hold(spark, sf_dir):
    return _streamed(spark, sf_dir, live.EchoHold())


@query(_SEGMENTS(True))
def stream_segments(spark, sf_dir):
    return _streamed(spark, sf_dir, live.Segments())


@query(_QUEUE(True))
def stream_queue(spark, sf_dir):
    return _streamed(spark, sf_dir, live.Queue())


@query(_HEALTH(True))
def stream_source_health(spark, sf_dir):
    return _streamed(spark, sf_dir, live.SourceHealth(rest_ms=REST_MS))


@query(f"""
WITH {_SESSION_ROWS}, w AS (SELECT user_id, ms, event_id, list_sort(list(level) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)) AS v FROM rows_, clock WHERE ms < t)
SELECT user_id, ms, 'latency' AS what, event_id, (floor(v[ceil(len(v) * 0.95::DOUBLE)::BIGINT] * 100))::BIGINT::VARCHAR AS text, round(v[ceil(len(v) * 0.5::DOUBLE)::BIGINT], 6) AS score FROM w
""")
def stream_latency(spark, sf_dir):
    """Rolling quantiles of the last 300 values, kept as a list in the state."""
    return _streamed(spark, sf_dir, live.RollingLatency())


@query(f"WITH j AS ({SQL['judge']}) SELECT passed, count(*)::BIGINT AS n, round(avg(average), 6) AS average FROM j GROUP BY 1")
def judge_totals(spark, sf_dir):
    return tq.judge(spark, sf_dir).groupBy("passed").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("average"), 6).alias("average"))


@query("SELECT concat_ws(',', CASE WHEN n < 1500 THEN 'records_below_threshold(' || n || '<1500)' END, CASE WHEN bad > 0 THEN 'quality_gate_blocked' END) AS blocked_reasons FROM (SELECT count(*) AS n, count(*) FILTER (quality = 0) AS bad FROM labels)")
def pretrain_gate(spark, sf_dir):
    one = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("quality") == 0).alias("bad"))
    reasons = F.concat_ws(",", F.when(C("n") < 1500, F.format_string("records_below_threshold(%d<1500)", C("n"))), F.when(C("bad") > 0, "quality_gate_blocked"))
    return one.select(reasons.alias("blocked_reasons"))


@query(f"SELECT p_partkey, 'I would describe ' || p_name || ' as ' || {q.normalize('p_type')} || ' I would then connect it to a concrete production example, explain the tradeoffs, and mention how I would validate the decision in practice.' AS answer FROM part")
def glossary_answers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fl.glossary_answer(C("p_name"), C("p_type")).alias("answer"))


@query("""
WITH a AS (SELECT event_id, props, value / 400.0::DOUBLE AS c FROM events), b AS (SELECT event_id, least(1.0::DOUBLE, c) AS confidence, 'k is ' || (props::JSON ->> 'k') AS answer FROM a)
SELECT event_id, confidence, CASE WHEN confidence >= 0.82 THEN 'high' WHEN confidence >= 0.58 THEN 'medium' ELSE 'low' END AS band, answer, 'low_context,not_first_person,too_short' AS flags FROM b
""")
def assist_parse(spark, sf_dir):
    """Model output with noise around its JSON becomes an assist: answer, clamped confidence, band and flags."""
    raw = F.format_string('sure: {"answer_en": "k is %s", "confidence": %s, "risk_flags": ["low_context"]} done', F.get_json_object("props", "$.k"), (C("value") / 400.0).cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    got = F.from_json(t.json_object(C("raw")), "answer_en STRING, confidence DOUBLE, risk_flags ARRAY<STRING>")
    rows = rows.select("event_id", got.alias("a")).select("event_id", sc.confidence(C("a.confidence")).alias("confidence"), C("a.answer_en").alias("answer"), C("a.risk_flags").alias("risks"))
    return rows.select("event_id", "confidence", sc.confidence_band(C("confidence")).alias("band"), "answer", F.array_join(sc.live_flags(C("answer"), C("risks")), ",").alias("flags"))


SOURCES = [("screen:1", "Entire screen"), ("window:2", "Editor Window"), ("screen:3", "Display 2"), ("window:4", "Browser"), ("SCREEN:5", "screen window")]
_SRC = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SOURCES) + ") AS v(id, name))"


@query(f"WITH {_SRC}, c AS (SELECT id, (starts_with(lower(id), 'screen:')::INT * 40 + contains(lower(name), 'entire screen')::INT * 30 + contains(lower(name), 'screen')::INT * 20 + contains(lower(name), 'display')::INT * 12 - contains(lower(name), 'window')::INT * 10) AS score FROM s) SELECT id, score::INT AS score, (row_number() OVER (ORDER BY id = 'window:2' DESC, score DESC, id))::INT AS rank FROM c WHERE id <> 'screen:3'")
def audio_rank(spark, sf_dir):
    rows = spark.createDataFrame(SOURCES, "id string, name string").where("id <> 'screen:3'").withColumn("score", fl.source_score(C("id"), C("name")))
    w = Window.orderBy((C("id") == "window:2").desc(), C("score").desc(), "id")
    return rows.select("id", "score", F.row_number().over(w).alias("rank"))


@query("SELECT event_id, greatest(120, least(3000, floor(value * 10 + 0.5)))::BIGINT AS min_audio_ms, greatest(80, least(2500, floor(value * 8 + 0.5)))::BIGINT AS silence_ms, greatest(50.0::DOUBLE, least(3000.0::DOUBLE, value)) AS threshold, CASE WHEN event_type = 'click' THEN 'profile_only' WHEN event_type = 'view' THEN 'general_then_profile' ELSE 'auto' END AS policy FROM events")
def settings_clamp(spark, sf_dir):
    policy = fl.one_of(F.when(C("event_type") == "click", "profile_only").when(C("event_type") == "view", "general_then_profile").otherwise("other"), ["profile_only", "general_then_profile"], "auto")
    ms = lambda c, low, high: fl.clamped_ms(c, low, high)
    return table(spark, sf_dir, "events").select("event_id", ms(C("value") * 10, 120, 3000).alias("min_audio_ms"), ms(C("value") * 8, 80, 2500).alias("silence_ms"), F.greatest(F.lit(50.0), F.least(F.lit(3000.0), C("value"))).alias("threshold"), policy.alias("policy"))


@query("WITH l AS (SELECT (['checkpoint', 'train', 'eval'])[event_id % 3 + 1] AS kind, event_id // 20 AS step, event_id, value FROM events) SELECT kind, max(step)::BIGINT AS step, arg_max(value, struct_pack(s := step, e := event_id)) AS latest, count(*)::BIGINT AS n FROM l GROUP BY 1")
def run_log_summary(spark, sf_dir):
    """The latest checkpoint by step and the last log of training and of evaluation; events stand for the lines of a log."""
    kind = F.element_at(F.array(*map(F.lit, ["checkpoint", "train", "eval"])), (C("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(kind.alias("kind"), F.floor(C("event_id") / 20).alias("step"), "event_id", "value")
    return rows.groupBy("kind").agg(F.max("step").alias("step"), F.max_by("value", F.struct("step", "event_id")).alias("latest"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL ORDER BY doc_id DESC LIMIT 20")
def reviewed_list(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL").orderBy(C("doc_id").desc()).limit(20).select("doc_id", "quality")
