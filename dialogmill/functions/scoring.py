"""Classifiers and scores on columns. Scores that are sums of hundredths are summed as whole numbers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.functions import constants as K
from dialogmill.functions import similarity as s
from dialogmill.functions import text as t


def detect_language(c: Column) -> Column:
    """tr or en by occurrences of stop words as substrings; Turkish letters count twice."""
    c = F.coalesce(c, F.lit(""))
    low = F.lower(c)
    tr = t.substring_count(low, K.TR_STOPWORDS) + F.when(c.rlike(f"[{K.TR_LETTERS}]"), 2).otherwise(0)
    return F.when(tr > t.substring_count(low, K.EN_STOPWORDS), "tr").otherwise("en")


def noise(c: Column) -> Column:
    """Navigation and consent pages: markers with short lines, or short repeated lines."""
    c = F.coalesce(c, F.lit(""))

    def judge(lines: Column) -> Column:
        n = F.size(lines)
        short = F.size(F.filter(lines, lambda x: F.length(x) < 40)) / n
        marked = t.let(F.lower(c), lambda low: t.contains_count(low, K.NOISE_MARKERS) >= 4)
        repeated = (F.length(c) < 2200) & (F.size(F.array_distinct(lines)) / n <= 0.42)
        return F.when(n == 0, True).otherwise(t.let(short, lambda part: F.when(part < 0.6, False).otherwise(((part >= 0.72) & repeated) | marked)))

    return t.let(F.filter(F.transform(F.split(c, r"[\r\n]+", -1), t.strip), lambda x: x != ""), judge)


def web_quality(c: Column, title: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    cap = lambda x, most: F.least(x / F.lit(float(most)), F.lit(1.0))
    braces = lambda b: F.length(c) - F.length(F.replace(c, F.lit(b), F.lit("")))

    def score(words: Column) -> Column:
        n = F.size(words)
        tech = F.size(F.filter(words, lambda w: w.isin(K.TECH_HINTS)))
        # one hit for each word, as words can't overlap
        asks = F.size(F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.isin(K.QUESTION_HINTS)))
        sents = F.regexp_count(c, F.lit(r"[^.!?]+[.!?]+"))
        total = cap(n, 1600) * 0.3 + F.size(F.array_distinct(words)) / n * 0.2 + cap(tech, 22) * 0.3 + cap(asks, 12) * 0.1 + cap(sents, 40) * 0.1
        total = total - F.when((braces("{") > 14) | (braces("}") > 14), 0.05).otherwise(0.0) + F.when(F.lower(title).contains("interview"), 0.03).otherwise(0.0)
        return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))

    return t.let(F.regexp_extract_all(low, F.lit(r"[A-Za-z0-9_\-À-ɏ]+"), F.lit(0)), score)


def answer_hundredths(answer: Column, question: Column | None = None) -> Column:
    words = t.word_count(answer)
    parts = [(18, t.first_person(answer)), (15, words.between(K.MIN_WORDS, K.MAX_WORDS)), (5, ~t.bullet_heavy(answer)), (5, ~t.code_block(answer)), (4, ~t.ai_disclaimer(answer)), (3, ~t.asks_back(answer))]
    if question is not None:
        parts.append((3, s.overlap(question, answer) >= 0.05))
    return F.lit(45) + reduce(lambda a, b: a + b, [F.when(test, n).otherwise(0) for n, test in parts])


def answer_quality(answer: Column, question: Column | None = None, context: Column | None = None, candidate_specific: Column | None = None) -> Column:
    score = answer_hundredths(answer, question) / 100.0
    if candidate_specific is not None and context is not None:
        score = score + F.when(candidate_specific, F.least(F.lit(0.07), s.groundedness(answer, context) * 0.12)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 4)


def _first_of(low: Column, rules: list[tuple[list[str], str | Column]], default: str) -> Column:
    out = None
    for terms, name in rules:
        name = name if isinstance(name, Column) else F.lit(name)
        out = F.when(t.has_any(low, terms), name) if out is None else out.when(t.has_any(low, terms), name)
    return out.otherwise(default)


def _ai(low: Column) -> Column:
    return F.when(t.has_any(low, K.SERVING_KEYWORDS), "mlops_infra").otherwise("nlp_and_llm")


def classify(question: Column, answer: Column) -> Column:
    """Category by the first list with a substring in the pair."""
    rules = lambda low: [(K.BEHAVIORAL_KEYWORDS, "behavioral_interview"), (K.AI_KEYWORDS, _ai(low)), (K.SECURITY_KEYWORDS, "security_appsec"), (K.DATABASE_KEYWORDS, "database_engineering"), (K.BACKEND_KEYWORDS, "backend_api"), (K.SYSTEM_KEYWORDS, "system_design")]
    return t.let(F.lower(F.concat(t.normalize(question), F.lit("\n"), t.normalize(answer))), lambda low: _first_of(low, rules(low), "coding_foundations"))


def classify_import(question: Column, answer: Column) -> Column:
    """The importer's categories: other lists, another order."""
    rules = lambda low: [(K.IMPORT_BEHAVIORAL_KEYWORDS, "behavioral_interview"), (K.IMPORT_AI_KEYWORDS, _ai(low)), (K.IMPORT_SECURITY_KEYWORDS, "security_appsec"), (K.IMPORT_DATABASE_KEYWORDS, "database_engineering"), (K.IMPORT_API_KEYWORDS, "backend_api"), (K.IMPORT_DESIGN_KEYWORDS, "system_design")]
    return t.let(F.lower(F.concat(question, F.lit("\n"), answer)), lambda low: _first_of(low, rules(low), "coding_foundations"))


def import_terms() -> list[str]:
    return sorted({*K.IMPORT_AI_KEYWORDS, *K.IMPORT_BEHAVIORAL_KEYWORDS, *K.IMPORT_SYSTEM_KEYWORDS})


def import_quality(question: Column, answer: Column, category: Column) -> Column:
    hits = t.let(F.lower(F.concat(question, F.lit("\n"), answer)), lambda low: t.contains_count(low, import_terms()))
    cap = lambda x, most: F.least(x / F.lit(float(most)), F.lit(1.0))
    fixed = F.lit(20) + F.when(question.contains("?"), 10).otherwise(0) + F.when(category.isin("nlp_and_llm", "mlops_infra", "behavioral_interview"), 10).otherwise(0) + F.when(F.length(answer) > 120, 5).otherwise(0)
    return F.round(F.least(F.lit(0.95), fixed / 100.0 + cap(t.word_count(answer), 180) * 0.35 + cap(hits, 4) * 0.25), 4)


def keep_import(question: Column, answer: Column, least: int, most: int) -> Column:
    q, a = t.normalize(question), t.normalize(answer)
    return (a != "") & (F.length(q) >= 12) & t.word_count(a).between(least, most) & t.let(F.lower(F.concat(q, F.lit("\n"), a)), lambda low: t.has_any(low, import_terms()))


def keep_answer(answer: Column, least: int = K.MIN_WORDS, most: int = K.MAX_WORDS) -> Column:
    return (t.normalize(answer) != "") & t.word_count(answer).between(least, most) & (F.size(t.sentences(answer)) >= 2)


def live_flags(answer: Column, risks: Column) -> Column:
    c = F.coalesce(answer, F.lit(""))
    own = [("not_first_person", ~t.has_word(c, K.LIVE_FIRST_PERSON)), ("too_short", F.size(F.split(c, r"(?U)\s+", -1)) < 35), ("too_long", F.length(c) > 900)]
    return F.array_distinct(F.concat(F.coalesce(risks, F.array().cast("array<string>")), F.array_compact(F.array(*[F.when(test, F.lit(flag)) for flag, test in own]))))


def confidence(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 0.72).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.82, "high").when(c >= 0.58, "medium").otherwise("low")


def question_flavor(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    hits: Callable[[list[str]], Column] = lambda marks: reduce(lambda a, b: a + b, [low.rlike(f"{t.LEFT}{m}{t.RIGHT}").cast("int") for m in marks])
    daily, personal, general = hits(K.DAILY_MARKERS), hits(K.PERSONAL_MARKERS), hits(K.GENERAL_MARKERS)
    return F.when(daily > 0, "personal_daily").when((personal > 0) & (general > 0), "mixed").when(general > 0, "technical_general").when(personal > 0, "candidate_specific").otherwise("mixed")


def intent(c: Column) -> Column:
    flavor = question_flavor(c)
    return F.when(flavor == "personal_daily", "candidate_specific").otherwise(flavor)


def answer_mode(intent_class: Column, policy: Column) -> Column:
    by_intent = F.when(intent_class == "candidate_specific", "profile_first").when(intent_class == "technical_general", "general_first").otherwise("balanced")
    return F.when(policy == "profile_only", "profile_only").when(policy == "general_then_profile", "general_first").otherwise(by_intent)


def rule_judge(answer: Column, quality: Column, candidate_specific: Column) -> Column:
    """struct of five scores, the mean and the verdict."""
    c = F.coalesce(answer, F.lit(""))
    failures = F.size(t.failure_tags(answer))
    grounded = F.least(F.lit(5), F.greatest(F.lit(1), F.bround(quality * 5).cast("int")))
    grounded = F.when(candidate_specific & (quality < 0.6), F.least(grounded, F.lit(3))).otherwise(grounded)
    speak = F.when(failures == 0, 5).otherwise(F.greatest(F.lit(1), F.lit(5) - failures))
    correct = F.when(quality >= 0.8, 5).when(quality >= 0.65, 4).when(quality >= 0.5, 3).otherwise(2)
    tone = F.when(t.first_person(c) & ~c.endswith("?"), 5).otherwise(3)
    concise = F.when(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")).between(K.MIN_WORDS, K.MAX_WORDS), 5).otherwise(3)
    scores = F.struct(correct.alias("correctness"), grounded.alias("groundedness"), speak.alias("speakability"), tone.alias("copilot_tone"), concise.alias("concision"), failures.alias("failures"))

    def verdict(x: Column) -> Column:
        total = x["correctness"] + x["groundedness"] + x["speakability"] + x["copilot_tone"] + x["concision"]
        passed = (total >= 21) & (F.least(x["correctness"], x["groundedness"], x["speakability"]) >= 4) & (x["failures"] == 0)
        return F.struct(x["correctness"].alias("correctness"), x["groundedness"].alias("groundedness"), x["speakability"].alias("speakability"), x["copilot_tone"].alias("copilot_tone"), x["concision"].alias("concision"), (total / 5.0).alias("average"), passed.alias("passed"))

    return t.let(scores, verdict)


def weighted_score(ttft: Column, final: Column, quality: Column, grounding: Column, malformed: Column, hallucination: Column, contradiction: Column) -> Column:
    """Latency 40, quality 35, grounding 15, stability 10 per cent; a missing or zero latency counts as 1e9 ms."""
    late = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1e9))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    latency = F.greatest(F.lit(0.0), 5.0 - late(ttft) / 300.0 - late(final) / 1500.0)
    stable = F.greatest(F.lit(0.0), 5.0 - 5.0 * zero(malformed) - 5.0 * zero(hallucination) - 5.0 * zero(contradiction))
    return F.round(latency * 0.40 + zero(quality) * 0.35 + F.greatest(F.lit(0.0), 5.0 * zero(grounding)) * 0.15 + stable * 0.10, 4)


def combined_latency(ttft: Column, final: Column) -> Column:
    late = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1e9))
    return late(ttft) + late(final)


def error_rate(errors: Column, transcripts: Column) -> Column:
    return F.when(errors + transcripts > 0, F.round(errors / (errors + transcripts), 4)).otherwise(0.0)


def evaluate(rows: DataFrame, expected: Column, strategic: Column, against: Column, malformed: Column) -> DataFrame:
    """rows (question, answer, ...) with what a benchmark looks at: words that are expected, strategic or speak against the persona, and three scores from 1 to 5."""
    a = F.col("answer")
    low = F.lower(t.normalize(a))
    found = lambda words: F.filter(words, lambda k: F.contains(F.col("__low"), k))
    rows = rows.withColumn("__low", low).withColumn("__tags", t.failure_tags(a)).withColumns({"__hits": found(expected), "__strategic": found(strategic), "__against": found(against)})
    share = lambda hits, words: F.size(hits) / F.greatest(F.lit(1), F.size(words))
    cap = lambda c: F.least(F.lit(5.0), F.greatest(F.lit(1.0), c))
    one = lambda c: c.cast("int")
    hit = F.size("__hits") > 0
    natural = 2.0 + one(~F.array_contains("__tags", "not_first_person")) + one(t.word_count(a).between(35, 140)) + one(F.size(t.sentences(a)) >= 2) - F.when(F.size("__tags") > 0, 0.5).otherwise(0.0)
    contradiction = F.size("__against") > 0
    out = rows.withColumns({
        "first_person": t.first_person(a), "grounding_hit": hit | (s.overlap(F.col("question"), a) >= 0.08), "keyword_hit_rate": F.round(share("__hits", expected), 4), "contradiction": contradiction, "malformed": malformed,
        "hallucination": contradiction | malformed | F.array_contains("__tags", "contains_code") | F.array_contains("__tags", "ai_disclaimer"),
        "quality": cap(F.round(answer_hundredths(a, F.col("question")) / 100.0 * 5 + F.when(hit, 0.4).otherwise(0.0), 2)),
        "strategic": cap(F.round(2.0 + 2.0 * F.size("__strategic") / F.greatest(F.lit(1), F.size(strategic)) + F.when(F.col("__low").contains("because"), 0.5).otherwise(0.0), 2)), "naturalness": cap(natural),
    })
    return out.drop("__low", "__tags", "__hits", "__strategic", "__against")


def quality_summary(evaluated: DataFrame, rates: list[str], means: list[str]) -> DataFrame:
    """One row: count, the share of each flag and the mean of each score; zeros without rows."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return evaluated.agg(F.count(F.lit(1)).alias("count"), *[mean(F.col(c).cast("int")).alias(c) for c in rates], *[mean(F.col(c)).alias(c) for c in means])
