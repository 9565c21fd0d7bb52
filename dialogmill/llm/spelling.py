"""Spelling variants by an even-partition pigeonhole join.

A word is cut in the middle of its length into two segments. One edit spoils at most one of them, so two near words share the
other: words are indexed by (length, cut, segment), and words of equal length, or one longer, probe with the substring at the
place where the segment has moved to. What is left of both words, the rest, must be one edit apart.

A segment that many words share is cut again, by the same rule, in its rest: the edit lies in one half of that, too. This goes on
until few words share a key, or the rest has one letter, where the alphabet bounds them. So no key pairs a large group, and no pair
is lost. A pair that several keys find counts where the leftmost cuts find it.

Nulls: a null text has no words; a null id counts as the empty text in the hash. Texts are taken whole, whatever their length.
Repeated rows count again. Ties of n go to the smaller word in code-point order. An empty table, or one without a word of
``least_n`` occurrences, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import materialize, table

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_CHARS = 5
LEAST_N = 3
#: One run in so many loses a letter.
EVERY = 97
#: A key is cut again if its words would make more than the square of this in candidates.
MOST = 32
_KEY = ["size", "at", "rest_size", "key"]


def runs(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """id, run: the maximal runs of letters, A-Z lower-cased, that can still have ``least_chars`` letters."""
    raw = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("raw"))
    lower = F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return raw.select("id", F.when(F.col("raw").rlike("[A-Z]"), lower).otherwise(F.col("raw")).alias("run"))


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, every: int = EVERY) -> DataFrame:
    """word, n: the runs, every ``every``-th of them with a letter deleted, that occur ``least_n`` times or more."""
    marked = runs(docs, least_chars).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, short).otherwise(F.col("run"))
    return marked.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _halves(size: Column, at: Column, rest_size: Column, key: Column, rest: Column) -> Column:
    """Both cuts of a rest: one half joins the key, the other is the new rest. ``rest`` has one letter more than ``rest_size`` in a longer word."""
    left = F.floor(rest_size / 2).cast("int")
    right, over = rest_size - left, F.length(rest) - rest_size
    head, tail = F.substring(key, F.lit(1), at), F.substring(key, at + 1, F.length(key))
    first = F.concat(head, F.substring(rest, F.lit(1), left), tail)  # the left half is alike
    second = F.concat(head, F.substring(rest, left + over + 1, right), tail)  # the right one, moved
    return F.array(
        F.struct(size.alias("size"), (at + left).alias("at"), right.alias("rest_size"), first.alias("key"), F.substring(rest, left + 1, right + over).alias("rest")),
        F.struct(size.alias("size"), at.alias("at"), left.alias("rest_size"), second.alias("key"), F.substring(rest, F.lit(1), left + over).alias("rest")),
    )


def _cut(entries: DataFrame) -> DataFrame:
    cut = _halves(*[F.col(c) for c in (*_KEY, "rest")])
    return entries.select("word", "n", "longer", F.explode(cut).alias("c")).select("word", "n", "longer", "c.*")


def _pairs(entries: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of all near words that share a key."""
    a = entries.where("NOT longer").select(*_KEY, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
    b = entries.select(*_KEY, "longer", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
    leftmost = (F.col("at") + F.col("rest_size") == F.col("size")) | (F.substring("b_rest", F.lit(1), F.col("rest_size")) != F.col("a_rest"))
    near = F.levenshtein("a_rest", "b_rest", 1) == 1
    return a.join(b, _KEY).where(F.when(F.col("longer"), leftmost).otherwise(F.col("a") < F.col("b")) & near).select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, a_n, b, b_n: every pair of words (word, n) that one inserted, deleted or replaced letter sets apart, once."""
    own = words.select("word", F.col("n").cast("long").alias("n"), F.length("word").alias("size"))
    both = F.array(F.struct(F.lit(False).alias("longer"), F.col("size").alias("size")), F.struct(F.lit(True).alias("longer"), (F.col("size") - 1).alias("size")))
    start = own.select("word", "n", F.explode(both).alias("as")).select("word", "n", "as.*", F.lit(0).alias("at"), F.lit("").alias("key"), F.col("word").alias("rest"))
    entries = _cut(start.withColumn("rest_size", F.col("size")))
    found = None
    while True:
        entries = materialize(entries, "spelling-keys")
        indexed, all_ = F.sum(F.when(F.col("longer"), 0).otherwise(1)), F.count(F.lit(1))
        common = entries.groupBy(*_KEY).agg(indexed.alias("i"), all_.alias("m")).where(f"rest_size > 1 AND i * m > {most * most}").select(*_KEY)
        common = materialize(common, "spelling-common")
        last = common.isEmpty()
        pairs = _pairs(entries if last else entries.join(common, _KEY, "left_anti"))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        entries = _cut(entries.join(common, _KEY, "left_semi"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the words of ``forms`` (word, form) with a form: the end of the chain of forms. Chains double their steps each round."""
    left = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = left.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if left.join(on.select("root"), "root", "left_semi").isEmpty():
            return left
        left = materialize(left.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, every: int = EVERY, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text)."""
    words = materialize(word_counts(docs, least_chars, least_n, every), "spelling-words")
    pairs = materialize(near_words(words, most), "spelling-pairs")
    sides = pairs.select("a", F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(pairs.select("b", "a", "a_n"))
    best = sides.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"))
    is_form = -F.col("best.order") >= 2 * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.order")).alias("form_n"))
    out = materialize(out, "spelling-forms")
    return out.join(roots(out), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op11_sql(every: int = EVERY, least_n: int = LEAST_N) -> str:
    """Near words by equal deletions, the checksum bit by bit."""
    return f"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), runs AS (
  SELECT coalesce(doc_id::BIGINT::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL
), hashed AS (
  SELECT run, c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::INT]))) AS h
  FROM counted, crc_table
), words AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {least_n}
), holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS b FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * w.n THEN -b[1] END AS form_n FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, form, r.root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word) r USING (word)"""


OP11_SQL = op11_sql()
