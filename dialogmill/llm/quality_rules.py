"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a predicate that rejects a document. Its cost and its share of rejections are
measured on a bounded sample; the rules then run in the order of rejections per second inside
one CASE, so that a row leaves at its first rejection. The order changes the speed, never the
verdict: a document is kept if no rule rejects it.

Nulls: a null text counts as the empty text; null ids are passed on. Empty texts have no word
and fail the base test. Texts are judged whole, whatever their length. Rules that reject alike per second
stand in the order of their names. Repeated rows are judged one by one. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import BLANKS, WORD, table, text_of

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over text, words and the base statistics."""

    name: str
    rejects: str


#: Thresholds are shares of words or lines, in whole numbers.
RULES = [
    Rule("mean_word", "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("exclamations", "10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words"),
    Rule("capitals", r"2 * regexp_count(text, '\\p{Lu}') > regexp_count(text, '\\p{L}')"),
    Rule("no_letters", r"10 * size(filter(words, w -> w rlike '\\p{L}')) < 8 * n_words"),
    Rule("stutter", "5 * size(filter(words, (w, i) -> i > 0 AND words[greatest(i - 1, 0)] = w)) > n_words"),
]


def base_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, words and the base statistics of every row.

    Repeated windows are found by sorting the (hash, position) pairs of one text, so the work is
    n log n in the words of a text and nothing is shuffled.
    """
    start = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    split = start.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.expr(r"filter(split(text, '\n', -1), l -> l rlike '[^ \\x09-\\x0D]')").alias("lines"))
    windows = split.select(
        "doc_id", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) >= 4 THEN sort_array(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS p))) ELSE cast(array() AS array<struct<h:bigint,p:int>>) END").alias("s"),
    )
    found = windows.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].h = x.h) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = x.h)), x -> x.p))"))
    return found.drop("s").withColumn("n_repeat_words", F.expr("aggregate(p, named_struct('last', -3, 'n', 0L), (a, q) -> named_struct('last', q, 'n', a.n + least(3, q - a.last)), a -> a.n)")).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, rounds: int = 24) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share rejected) on about ``sample_rows`` rows, picked by a hash of id and text.

    Each rule is evaluated ``rounds`` times a row in one job, and the time of the same job with a rule that costs
    nothing is taken off, so that the job's own time doesn't count. The share that is picked follows the number of rows,
    so a task emits few rows however many tasks there are.
    """
    share = min(1.0, 1.2 * sample_rows / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = base_statistics(picked.limit(sample_rows)).persist()
    try:
        rows = sample.count()
        if not rows:
            return [(rule, 1.0, 0.0) for rule in rules]
        again = sample.withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))

        def timed(sql: str) -> tuple[float, int]:
            best, hits = 1e9, 0
            for _ in range(2):
                began = time.perf_counter()
                hits = again.agg(F.count_if(F.expr(f"({sql}) AND __round > 0"))).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        floor = timed("n_words < 0")[0]
        out = []
        for rule in rules:
            seconds, hits = timed(rule.rejects)
            out.append((rule, max(seconds - floor, 1e-4) / (rows * rounds), hits / (rows * rounds)))
        return out
    finally:
        sample.unpersist()


def order(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per second first; ties by name."""
    return [rule for rule, seconds, share in sorted(measured, key=lambda m: (-m[2] / m[1], m[0].name))]


def cascade(rules: list[Rule], failed: Column) -> Column:
    """True if nothing rejects; CASE stops at the first branch that holds."""
    out = F.when(failed, False)
    for rule in rules:
        out = out.when(F.expr(rule.rejects), False)
    return out.otherwise(True)


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base statistics, base_failed and kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    ordered = order(measure(docs, rules or RULES, sample_rows))
    stats = base_statistics(docs)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), cascade(ordered, base_failed()).alias("kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^ \x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')) AS lines FROM t),
b AS (
  SELECT doc_id, text, words, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[ \x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM w),
g AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM b)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + d)::BIGINT AS n FROM r, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
f AS (SELECT b.*, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN p USING (doc_id)),
k AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 2 * word_chars < 5 * n_words OR word_chars > 14 * n_words
    OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * n_lines
    OR 10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words
    OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}'))
    OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 8 * n_words
    OR 5 * len(list_filter(range(2, n_words + 1), lambda i: words[i] = words[i - 1])) > n_words) AS kept
FROM k
"""
