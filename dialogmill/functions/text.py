"""Text functions on columns. All take and return Columns and stay in the JVM.

Null texts count as the empty text. White space is Unicode's where text is stripped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmill.functions import constants as K

# fixed value: what a word is made of
WORD = r"[\p{L}\p{N}_À-ɏ'-]+"
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Edges of a word in all regular-expression dialects alike.
LEFT, RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def normalize(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.coalesce(c, F.lit("")), " [ \t]+|\t[ \t]*", " "))


def squeezed(c: Column) -> Column:
    """normalize() of a text whose blanks are single already."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))


def again(c: Column) -> Column:
    """normalize() of what normalize() has returned, which can differ only by line ends that were behind another return."""
    return F.when(c.contains("\r"), normalize(c)).otherwise(c)


def key(c: Column) -> Column:
    return F.regexp_replace(F.lower(normalize(c)), r"(?U)\s+", " ")


def sentences(c: Column) -> Column:
    return _sentences(normalize(c))


def _sentences(c: Column) -> Column:
    """sentences() of a normalized text."""
    found = F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]+|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def word_count(c: Column) -> Column:
    """Words of normalize(c), which changes only what is between words, so the text is taken as it is."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0)))


def any_of(terms: list[str]) -> str:
    """An alternation of the terms as they are."""
    return "|".join(t.replace("-", r"\-").replace(".", r"\.") for t in terms)


def has_any(c: Column, terms: list[str]) -> Column:
    """Whether one of the terms is a substring: faster than a pattern of all, if ``c`` is at hand, as in let()."""
    return reduce(lambda a, b: a | b, [c.contains(x) for x in terms])


def has_word(c: Column, terms: list[str]) -> Column:
    """Whether normalize(c) has one of the terms. Only a term with white space in it needs the blanks made single."""
    text = normalize(c) if any(x.split() != [x] for x in terms) else F.coalesce(c, F.lit(""))
    return F.lower(text).rlike(f"{LEFT}({any_of(terms)}){RIGHT}")


def first_person(c: Column) -> Column:
    return has_word(c, K.FIRST_PERSON)


def ai_disclaimer(c: Column) -> Column:
    return has_word(c, K.AI_DISCLAIMERS)


# fixed values: the patterns of list items and of code
BULLET = r"(?m)^\s*([-*•]|\d+\.)\s+"
CODE = r"```|(^|[^\p{L}\p{N}_])(def\s+[\p{L}\p{N}_]+\(|class\s+[\p{L}\p{N}_]+\(|function\s+[\p{L}\p{N}_]+\()|\{\s*$"


def bullet_heavy(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(BULLET)) >= 2


def code_block(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(CODE)


def asks_back(c: Column) -> Column:
    return normalize(c).endswith("?")


def failure_tags(c: Column) -> Column:
    """The failures of an answer, in a fixed order."""
    words = word_count(c)
    trimmed = normalize(c)
    tags = [
        ("not_first_person", ~first_person(c)), ("too_short", words < K.MIN_WORDS), ("too_long", words > K.MAX_WORDS),
        ("bullet_only", bullet_heavy(trimmed)), ("contains_code", code_block(trimmed)), ("ai_disclaimer", ai_disclaimer(c)), ("asks_question_back", asks_back(c)),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in tags]))


def punctuated(c: Column) -> Column:
    return let(normalize(c), _ended)


def _ended(c: Column) -> Column:
    """punctuated() of a normalized text."""
    return F.when(c == "", "").when(c.rlike(r"[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))


def summarize_lines(lines: Column, max_chars: int = 420, max_lines: int = 6) -> Column:
    kept = F.slice(F.filter(F.transform(lines, normalize), lambda x: x != ""), 1, max_lines)
    return strip(F.substring(strip(F.array_join(kept, " ")), 1, max_chars))


def word_window(c: Column, most: int) -> Column:
    """The longest run of whole sentences from the start with at most ``most`` words; else the first tokens."""
    return let(normalize(c), lambda x: _window(x, most))


def _window(c: Column, most: int) -> Column:
    """word_window() of a normalized text."""
    def fold(a: Column, s: Column) -> Column:
        # words don't reach across the blank, so the sentences' counts add up
        longer = F.when(a["text"] == "", s).otherwise(F.concat(a["text"], F.lit(" "), s))
        more = let(a["n"] + word_count(s), lambda n: F.struct(F.when(n <= most, longer).otherwise(a["text"]).alias("text"), n.alias("n"), (n > most).alias("done")))
        return F.when(a["done"], a).otherwise(more)

    whole = F.aggregate(_sentences(c), F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("done")), fold, lambda a: a["text"])
    tokens = F.array_join(F.slice(F.split(c, r"(?U)\s+"), 1, most), " ")
    return F.when(word_count(c) <= most, _ended(c)).otherwise(let(whole, lambda w: F.when(w != "", punctuated(w)).otherwise(punctuated(tokens))))


def speakable(answer: Column, question: Column | None = None, most: int = K.MAX_WORDS, least: int = K.MIN_WORDS) -> Column:
    """struct(text, rewritten): the answer as it would be said, by one edit after another."""
    def step(state: Column, test: Callable[[Column], Column], edit: Callable[[Column], Column]) -> Column:
        return let(state, lambda s: let(test(s["text"]), lambda hit: F.struct(F.when(hit, edit(s["text"])).otherwise(s["text"]).alias("text"), (s["rewritten"] | hit).alias("rewritten"))))

    asked = normalize(question) if question is not None else F.lit("")
    template = F.concat(F.lit(K.EMPTY_ANSWER[0]), asked, F.lit(K.EMPTY_ANSWER[1]))
    disclaimer = rf"(?i){LEFT}({any_of(K.AI_DISCLAIMERS)})(?=$|[^\p{{L}}\p{{N}}_])"
    state = F.struct(normalize(answer).alias("text"), F.lit(False).alias("rewritten"))
    state = step(state, lambda t: (t == "") & (asked != ""), lambda t: template)
    state = step(state, bullet_heavy, lambda t: normalize(F.regexp_replace(t, BULLET, "")))
    state = step(state, code_block, lambda t: normalize(F.regexp_replace(t, r"(?s)```.*?```", " ")))
    state = step(state, lambda t: let(F.lower(again(t)), lambda low: has_any(low, K.AI_DISCLAIMERS)) & ai_disclaimer(t), lambda t: normalize(F.regexp_replace(t, disclaimer, "$1")))
    state = step(state, lambda t: (t != "") & ~first_person(t), lambda t: F.concat(F.lit(K.FIRST_PERSON_PREFIX), F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))
    state = let(state, lambda s: F.struct(let(again(s["text"]), lambda x: _window(x, most)).alias("text"), s["rewritten"].alias("rewritten")))
    state = step(state, lambda t: again(t).endswith("?"), lambda t: F.concat(strip(F.substring(t, F.lit(1), F.length(t) - 1)), F.lit(".")))
    state = step(state, lambda t: word_count(t) < least, lambda t: word_window(F.concat(t, F.lit("  " + K.SHORT_ANSWER_EXTENSION)), most))
    return let(state, lambda s: F.struct(let(again(s["text"]), _ended).alias("text"), s["rewritten"].alias("rewritten")))


def tokens(c: Column) -> Column:
    """Distinct lower-cased technical tokens. What normalize() changes is no part of one, so the text is taken as it is."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_+\-/]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(F.array_distinct(found), F.lower))


def glossary_tokens(c: Column) -> Column:
    """Candidate terms in their own case, without stop words."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_+\-]{2,30}"), F.lit(0))
    return F.filter(found, lambda t: ~F.lower(t).isin(K.GLOSSARY_STOPWORDS))


def token_set(c: Column, most: int = 260) -> Column:
    """Distinct tokens among the first ``most`` ones. A text whose head has one more is read no further."""
    found = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"[A-Za-z0-9_\-À-ɏ]+"), F.lit(0))
    whole, size = F.coalesce(c, F.lit("")), 10 * most
    head = let(found(F.substring(whole, 1, size)), lambda x: F.when((F.size(x) > most) | (F.length(whole) <= size), F.slice(x, 1, most)))
    return F.array_distinct(F.coalesce(head, F.slice(found(whole), 1, most)))


def fingerprint(token_array: Column) -> Column:
    return F.sha1(F.array_join(F.sort_array(token_array), " ").cast("binary"))


def qc_joined(token_array: Column) -> Column:
    return F.substring(F.array_join(F.sort_array(token_array), "|"), 1, 1000)


def qc_fingerprint(c: Column) -> Column:
    return qc_joined(tokens(c))


def sanitize(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n", "\n"), "\t", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+\n", "\n"), "\n{3,}", "\n\n"))


def speech(c: Column) -> Column:
    """Lower-cased letters, numbers and single spaces."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clip(c: Column, most: int = 240) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def merge(base: Column, following: Column) -> Column:
    """Two utterances as one: a prefix is absorbed and a trailing hyphen joins words."""
    a, b = strip(F.coalesce(base, F.lit(""))), strip(F.coalesce(following, F.lit("")))
    joined = F.when(a.endswith("-"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))
    return F.when(a == "", b).when(b == "", a).when(b.startswith(a), b).when(a.startswith(b), a).otherwise(strip(F.regexp_replace(joined, r"(?U)\s+", " ")))


def one_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def unfence(c: Column) -> Column:
    """Without code-fence marks at the starts and ends of lines."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)^```json", "")
    return strip(F.regexp_replace(F.regexp_replace(c, "(?m)^```", ""), "(?m)```$", ""))


def json_object(c: Column) -> Column:
    """The outermost braces of a noisy text; null if there are none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def file_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9_-]", ""), 1, 16)


def number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def model_family(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("llama"), "llama").when(low.contains("qwen"), "qwen").otherwise("other")


def combo(c: Column) -> Column:
    parts = F.split(c, ":", 2)
    return F.struct(F.trim(parts[0]).alias("stt"), F.trim(F.try_element_at(parts, F.lit(2))).alias("assist"))


def corpus_summary(text: Column, title: Column) -> Column:
    """The title and the first four parts with text; the rest of a text is cut into parts only where one of its first four is empty."""
    filled = lambda parts: F.filter(F.transform(parts, strip), lambda s: s != "")

    def base(clean: Column) -> Column:
        flat = F.replace(clean, F.lit("\n"), F.lit(" "))
        four = let(filled(F.slice(F.split(flat, r"\. ", 5), 1, 4)), lambda x: F.when(F.size(x) == 4, x).otherwise(F.slice(filled(F.split(flat, r"\. ", -1)), 1, 4)))
        return let(strip(F.array_join(four, ". ")), lambda x: F.when(x == "", F.substring(clean, 1, 720)).otherwise(x))

    return let(let(normalize(text), base), lambda x: F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), x)).otherwise(x))


def contains_count(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur as substrings."""
    return reduce(lambda a, b: a + b, [c.contains(t).cast("int") for t in terms])


def substring_count(c: Column, terms: list[str]) -> Column:
    """Occurrences of all terms, each counted without overlaps."""
    one = [((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in terms]
    return reduce(lambda a, b: a + b, one)
