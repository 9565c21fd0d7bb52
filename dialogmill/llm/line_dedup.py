"""Line dedup by a deletion-neighbourhood join, in built-in functions only.

A line is dropped if an equal line, or one within one edit, occurs earlier; the order is (doc_id,
hash of the text, line number). One edit inserts, deletes or replaces one character. Equal lines
are collapsed first. Of the distinct lines that are left, each emits itself and its variants with
one character deleted as hashed keys; equal keys meet, and every found pair is verified: the two texts, without
the characters that the variants lack, must be equal, which is an edit distance of one:

- two lines with the same variant, deleted at the same place, differ by a replacement;
- a line that equals a variant of another one differs from it by an insertion.

All members of such a meeting are within one edit of its earliest member, so each row of a meeting
is paired with that one only and no pairs within a group are made.

Variants are hashed in blocks of ``BLOCK`` characters; the hashes of the blocks before and behind a deletion
come from running combinations, made once a line, so that a line of any length costs as much as its characters.
Lines that can't have a partner emit nothing: two lines within one edit share their first or their last half,
so a line whose halves occur nowhere else at a length that is at most one apart has none. That prefilter
loses no pair.

Lines without a word are never dropped. All others are compared, however short; a caller to whom one edit
in a short line is another line ("Item 1", "Item 2") gives ``min_chars``, below which only equal lines go. A line
earlier than another counts even if it is itself dropped, so chains collapse onto their first line.

Nulls: a null text stays null; null ids come first. Rows with the same id and text count as one
document and keep the same lines. Rows are never dropped: a text whose every line goes becomes empty.
Texts and lines have no limit of length. Ties can't occur, as a place in the order has one line. Empty tables give
empty results. Extra columns stay with their row; n_lines and n_kept of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.llm.common import materialize, table

BLOCK = 256
MIN_CHARS = 1
HAS_WORD = r"[^ \x09-\x0D]"


def exploded(docs: DataFrame) -> DataFrame:
    """id, th (hash of the text), at (line number), line of every line with a word."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    return rows.select("id", "th", F.posexplode("lines").alias("at", "line")).where(F.col("line").rlike(HAS_WORD))


def half_keys(line: Column, chars: Column) -> Column:
    """Keys of the first and last halves, for the shorter length m of a possible pair: own length or one less."""
    keys = []
    for m in (chars, chars - 1):
        half = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), m, F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("tail"), m, F.substring(line, chars - (m - half) + 1, m - half)))
    return F.array(*keys)


def first_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """first (id, th, at) and keys of each distinct line; keys is null for short lines."""
    lines = exploded(docs).withColumn("chars", F.length("line"))
    keys = F.when(F.col("chars") >= min_chars, half_keys(F.col("line"), F.col("chars")))
    lines = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.struct("id", "th", "at").alias("o"), keys.alias("keys"))
    return lines.groupBy("h1", "h2").agg(F.min("o").alias("first"), F.min("keys").alias("keys")).select("first", "keys")


def candidates(firsts: DataFrame) -> DataFrame:
    """id, th, at of the distinct lines that share a half with another one, and which: head, tail.

    A line's own keys differ, so a key that occurs twice is shared.
    """
    keyed = firsts.where("keys IS NOT NULL").select("first", F.posexplode("keys").alias("p", "k"))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    found = keyed.join(shared, "k", "left_semi").groupBy("first").agg(F.bool_or(F.col("p") % 2 == 0).alias("head"), F.bool_or(F.col("p") % 2 == 1).alias("tail"))
    return found.select("first.id", "first.th", "first.at", "head", "tail")


def with_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, th, at, head, tail, line of the wanted places."""
    per = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("at", "head", "tail")).alias("ats")).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "ats")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    rows = rows.join(per, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    rows = rows.select("id", "th", "ats", F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("id", "th", F.explode(F.expr("transform(ats, p -> struct(p.at, p.head, p.tail, element_at(lines, p.at + 1) AS line))")).alias("p"))
    # repeated rows have the same lines
    return rows.select("id", "th", "p.*").dropDuplicates(["id", "th", "at"])


def variants(lines: DataFrame) -> DataFrame:
    """first, v (key), i: the line itself with i = -1, and each variant with its deleted place.

    The edit between lines that share their heads is behind these, and the other way round, so a line
    deletes there only.
    """
    chars = F.length("line")
    low = F.when(F.col("tail"), 0).otherwise(F.floor((chars - 1) / 2).cast("int"))
    high = F.when(F.col("head"), chars).otherwise(chars - F.ceil((chars - 1) / 2).cast("int"))
    start = lines.select(F.struct("id", "th", "at").alias("first"), "line", chars.alias("chars"), low.alias("low"), high.alias("high"))
    start = start.select("first", "low", "high", F.expr(f"regexp_extract_all(line, '(?s).{{1,{BLOCK}}}', 0)").alias("parts"))
    # j: number of the block; b: the block with the character behind it
    blocks = F.expr("transform(parts, (x, j) -> struct(j AS j, concat(x, coalesce(substring(get(parts, j + 1), 1, 1), '')) AS b))")
    own = F.expr("transform(parts, (x, j) -> xxhash64(x, j))")
    start = start.select("first", "low", "high", blocks.alias("blocks"), own.alias("own"))
    # the hash of the block one character further on
    moved = F.expr("transform(blocks, x -> if(length(x.b) > 1, xxhash64(substring(x.b, 2), x.j), 0L))")
    start = start.select("first", "low", "high", "blocks", "own", moved.alias("moved"))
    # combined hashes of the blocks before each place
    run = lambda a: F.expr(f"aggregate({a}, cast(array(0L) AS array<bigint>), (s, x) -> array_append(s, element_at(s, -1) ^ x))")
    start = start.select("first", "low", "high", "blocks", run("own").alias("before"), run("moved").alias("behind"))
    whole = start.select("first", F.expr("element_at(before, -1)").alias("v"), F.lit(-1).alias("i"))
    each = F.expr("transform(blocks, x -> struct(x.j AS j, x.b AS b, before[x.j] ^ element_at(behind, -1) ^ behind[x.j + 1] AS rest))")
    each = start.select("first", "low", "high", F.explode(each).alias("x")).select("first", "low", "high", "x", "x.rest")
    cut = F.expr(f"transform(filter(sequence(1, least({BLOCK}, length(x.b))), p -> x.j * {BLOCK} + p - 1 BETWEEN low AND high), p -> struct(x.j * {BLOCK} + p - 1 AS i, concat(substring(x.b, 1, p - 1), substring(x.b, p + 1)) AS b))")
    each = each.select("first", "rest", F.col("x.j").alias("j"), F.explode(cut).alias("d"))
    key = F.expr("if(d.b = '', 0L, xxhash64(d.b, j)) ^ rest")
    return whole.unionByName(each.select("first", key.alias("v"), F.col("d.i").alias("i")))


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """id, th, at of the distinct lines that have an earlier line within one edit."""
    lines = materialize(with_lines(docs, candidates(firsts)), "line-candidates")
    keys = variants(lines)
    by_key, by_place = Window.partitionBy("v"), Window.partitionBy("v", "i")
    met = keys.select(
        "first", "i",
        F.min(F.when(F.col("i") < 0, F.col("first"))).over(by_key).alias("whole"),
        F.min(F.when(F.col("i") >= 0, F.struct("first", "i"))).over(by_key).alias("cut"),
        F.min("first").over(by_place).alias("place"),
    )
    # i: the place that this line lacks in the variant, j: that of the other line; -1: none
    none = F.lit(-1)
    of_whole = F.array(F.struct(F.col("cut.first").alias("other"), none.alias("i"), F.col("cut.i").alias("j")))
    of_variant = F.array(F.struct(F.col("whole").alias("other"), F.col("i"), none.alias("j")), F.struct(F.col("place").alias("other"), F.col("i"), F.col("i").alias("j")))
    pairs = met.select("first", F.explode(F.when(F.col("i") < 0, of_whole).otherwise(of_variant)).alias("x")).where("x.other < first")
    # a run of one character gives a pair at each of its places
    pairs = pairs.groupBy("first", F.col("x.other").alias("other"), (F.col("x.i") < 0).alias("a"), (F.col("x.j") < 0).alias("b")).agg(F.min(F.struct("x.i", "x.j")).alias("at")).select("first", "other", "at.i", "at.j")
    text = lines.select(F.struct("id", "th", "at").alias("p"), "line")
    pairs = pairs.join(text.withColumnRenamed("line", "a"), F.col("first").eqNullSafe(F.col("p"))).drop("p")
    pairs = pairs.join(text.withColumnRenamed("line", "b"), F.col("other").eqNullSafe(F.col("p"))).drop("p")
    without = lambda line, at: f"if({at} < 0, {line}, concat(substring({line}, 1, {at}), substring({line}, {at} + 2)))"
    near = pairs.where(F.expr(f"{without('a', 'i')} = {without('b', 'j')}"))
    return near.select("first.id", "first.th", "first.at").distinct()


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the kept lines as text, and n_lines, n_kept (lines with a word)."""
    firsts = materialize(first_lines(docs, min_chars), "line-firsts")
    near = near_lines(docs, firsts).select(F.col("id").alias("__i"), F.col("th").alias("__t"), F.col("at").alias("__a"))
    kept = firsts.select("first.id", "first.th", "first.at")
    kept = kept.join(near, F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t")) & (F.col("at") == F.col("__a")), "left_anti")
    kept = kept.groupBy("id", "th").agg(F.collect_set("at").alias("__ats")).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__ats")
    rows = docs.select(F.struct("*").alias("__row"), F.xxhash64("text").alias("__h"))
    rows = rows.join(kept, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    rows = rows.select("__row", F.coalesce("__ats", F.array().cast("array<int>")).alias("__ats"), F.split("__row.text", "\n", -1).alias("__lines"))
    rows = rows.withColumn("__blank", F.expr(rf"filter(transform(__lines, (l, i) -> if(l rlike '{HAS_WORD}', -1, i)), i -> i >= 0)".replace("\\", "\\\\")))
    order = F.expr("array_intersect(transform(__lines, (l, i) -> i), concat(__ats, __blank))")
    rows = rows.select("__row", "__lines", "__blank", F.size("__ats").alias("__k"), order.alias("__order"))
    text = F.expr("array_join(transform(__order, i -> __lines[i]), '\n')")
    columns = [F.when(F.col("__row.text").isNotNull(), text).alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_kept")]
    return rows.select(*columns, F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines") - F.size("__blank")).cast("long").alias("n_lines"), F.when(F.col("__lines").isNull(), 0).otherwise(F.col("__k")).cast("long").alias("n_kept"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op3_sql(halves: bool = True, min_chars: int = MIN_CHARS) -> str:
    """The same lines by comparing pairs of lines, for small tables: all pairs, or with ``halves`` those that share their first or
    last half, as two lines within one edit do; tests hold the two against each other."""
    shorter = "least(length(a.line), length(b.line))"
    half = f"AND (left(a.line, ({shorter} // 2)::BIGINT) = left(b.line, ({shorter} // 2)::BIGINT) OR right(a.line, ({shorter} - {shorter} // 2)::BIGINT) = right(b.line, ({shorter} - {shorter} // 2)::BIGINT))"
    # that engine's distance counts bytes, so lines with other characters are compared with one character left out at every place
    out = lambda x, i: f"left({x}, {i} - 1) || substr({x}, {i} + 1)"
    each = lambda x, y: f"len(list_filter(range(1, length({x}) + 1), lambda i: {out(x, 'i')} = {y})) > 0"
    near = f"CASE WHEN strlen(a.line) = length(a.line) AND strlen(b.line) = length(b.line) THEN levenshtein(a.line, b.line) <= 1 WHEN length(a.line) = length(b.line) THEN {each('a.line', out('b.line', 'i'))} WHEN length(a.line) > length(b.line) THEN {each('a.line', 'b.line')} ELSE {each('b.line', 'a.line')} END"
    return _SQL.replace("{near}", near).replace("{half}", half if halves else "").replace("{min_chars}", str(min_chars))


_SQL = r"""
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM t),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^ \x09-\x0D]')),
f AS (SELECT line, min(struct_pack(id := doc_id, ln := ln)) AS o FROM w GROUP BY line),
n AS (SELECT DISTINCT a.line FROM f a JOIN f b ON length(b.line) BETWEEN length(a.line) - 1 AND length(a.line) + 1 AND b.o < a.o
  {half}
  WHERE length(a.line) >= {min_chars} AND length(b.line) >= {min_chars} AND {near}),
k AS (SELECT w.doc_id, w.text, w.ln, w.line FROM w JOIN f ON w.line = f.line AND f.o = struct_pack(id := w.doc_id, ln := w.ln) WHERE w.line NOT IN (SELECT line FROM n)),
r AS (SELECT doc_id, text, ln, line, 1 AS word FROM k UNION ALL SELECT doc_id, text, ln, line, 0 FROM l WHERE NOT regexp_matches(line, '[^ \x09-\x0D]')),
j AS (SELECT doc_id, text, string_agg(line, chr(10) ORDER BY ln) AS kept, sum(word)::BIGINT AS n_kept FROM r GROUP BY doc_id, text),
c AS (SELECT doc_id, text, count(*)::BIGINT AS n_lines FROM w GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(j.n_kept, 0)::BIGINT AS n_kept,
  CASE WHEN d.text IS NOT NULL THEN strlen(coalesce(j.kept, ''))::BIGINT END AS n_bytes,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(j.kept, '')) END AS text_md5
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id AND d.text = j.text LEFT JOIN c ON d.doc_id = c.doc_id AND d.text = c.text
"""

OP3_SQL = op3_sql()
