"""Fragments of the equivalent SQL. They share the word lists with the column functions."""

from __future__ import annotations

from dialogmill.functions import constants as K

WORD = r"[\p{L}\p{N}_À-ɏ''-]+"
LEFT, RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(quoted, values))


def any_of(terms: list[str]) -> str:
    return "|".join(x.replace("'", "''").replace("-", r"\-").replace(".", r"\.") for x in terms)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def normalize(c: str) -> str:
    c = f"replace(coalesce({c}, ''), chr(13) || chr(10), chr(10))"
    return strip(rf"regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def key(c: str) -> str:
    return rf"regexp_replace(lower({normalize(c)}), '\s+', ' ', 'g')"


def sentences(c: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({normalize(c)}, '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: {strip('s')}), lambda s: s <> '')"


def words(c: str) -> str:
    return f"len(regexp_extract_all({normalize(c)}, '{WORD}'))"


def has_word(c: str, terms: list[str]) -> str:
    return f"regexp_matches(lower({normalize(c)}), '{LEFT}({any_of(terms)}){RIGHT}')"


def first_person(c: str) -> str:
    return has_word(c, K.FIRST_PERSON)


def ai_disclaimer(c: str) -> str:
    return has_word(c, K.AI_DISCLAIMERS)


def bullet_heavy(c: str) -> str:
    return rf"(len(regexp_extract_all(coalesce({c}, ''), '(?m)^\s*([-*•]|\d+\.)\s+')) >= 2)"


def code_block(c: str) -> str:
    return rf"regexp_matches(coalesce({c}, ''), '```|(^|[^\p{{L}}\p{{N}}_])(def\s+[\p{{L}}\p{{N}}_]+\(|class\s+[\p{{L}}\p{{N}}_]+\(|function\s+[\p{{L}}\p{{N}}_]+\()|\{{\s*$')"


def asks_back(c: str) -> str:
    return f"ends_with({normalize(c)}, '?')"


def failure_tags(c: str) -> str:
    """A comma-separated list."""
    tests = [("not_first_person", f"NOT {first_person(c)}"), ("too_short", f"{words(c)} < {K.MIN_WORDS}"), ("too_long", f"{words(c)} > {K.MAX_WORDS}"), ("bullet_only", bullet_heavy(normalize(c))), ("contains_code", code_block(normalize(c))), ("ai_disclaimer", ai_disclaimer(c)), ("asks_question_back", asks_back(c))]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{tag}' END" for tag, test in tests) + ")"


def punctuated(c: str) -> str:
    return f"(CASE WHEN {normalize(c)} = '' THEN '' WHEN regexp_matches({normalize(c)}, '[.!?]$') THEN {normalize(c)} ELSE {normalize(c)} || '.' END)"


def tokens(c: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({normalize(c)}, '[A-Za-z][A-Za-z0-9_+\-/]{{2,}}'), lambda x: lower(x)))"


def overlap(left: str, right: str) -> str:
    a, b = tokens(left), tokens(right)
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END)"


def token_set(c: str, most: int = 260) -> str:
    return rf"list_distinct((regexp_extract_all(lower(coalesce({c}, '')), '[A-Za-z0-9_\-À-ɏ]+'))[1:{most}])"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def speech(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def clip(c: str, most: int) -> str:
    return f"(CASE WHEN length({c}) > {most} THEN substr({c}, 1, {most}) || '...' ELSE {c} END)"


def sanitize(c: str) -> str:
    c = f"replace(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(9), ' ')"
    return strip(rf"regexp_replace(regexp_replace({c}, '\s+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def merge(a: str, b: str) -> str:
    a, b = strip(f"coalesce({a}, '')"), strip(f"coalesce({b}, '')")
    joined = f"(CASE WHEN ends_with({a}, '-') THEN substr({a}, 1, length({a}) - 1) || {b} ELSE {a} || ' ' || {b} END)"
    return rf"(CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN starts_with({b}, {a}) THEN {b} WHEN starts_with({a}, {b}) THEN {a} ELSE {strip('regexp_replace(' + joined + ", '\\s+', ' ', 'g')")} END)"


def substring_count(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"(length({c}) - length(replace({c}, {quoted(x)}, ''))) // {len(x)}" for x in terms) + ")"


def contains_count(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {quoted(x)})::INT" for x in terms) + ")"


def detect_language(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    return f"(CASE WHEN {substring_count(low, K.TR_STOPWORDS)} + (CASE WHEN regexp_matches(coalesce({c}, ''), '[{K.TR_LETTERS}]') THEN 2 ELSE 0 END) > {substring_count(low, K.EN_STOPWORDS)} THEN 'tr' ELSE 'en' END)"


def answer_hundredths(answer: str, question: str | None = None) -> str:
    parts = [(18, first_person(answer)), (15, f"{words(answer)} BETWEEN {K.MIN_WORDS} AND {K.MAX_WORDS}"), (5, f"NOT {bullet_heavy(answer)}"), (5, f"NOT {code_block(answer)}"), (4, f"NOT {ai_disclaimer(answer)}"), (3, f"NOT {asks_back(answer)}")]
    if question:
        parts.append((3, f"{overlap(question, answer)} >= 0.05"))
    return "(45 + " + " + ".join(f"(CASE WHEN {test} THEN {n} ELSE 0 END)" for n, test in parts) + ")"


def keep_answer(c: str) -> str:
    return f"({normalize(c)} <> '' AND {words(c)} BETWEEN {K.MIN_WORDS} AND {K.MAX_WORDS} AND len({sentences(c)}) >= 2)"


def _first_of(low: str, rules: list[tuple[list[str], str]]) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches({low}, '{any_of(terms)}') THEN {name}" for terms, name in rules) + " ELSE 'coding_foundations' END)"


def _ai(low: str) -> str:
    return f"(CASE WHEN regexp_matches({low}, '{any_of(K.SERVING_KEYWORDS)}') THEN 'mlops_infra' ELSE 'nlp_and_llm' END)"


def classify(question: str, answer: str) -> str:
    low = f"lower({normalize(question)} || chr(10) || {normalize(answer)})"
    return _first_of(low, [(K.BEHAVIORAL_KEYWORDS, "'behavioral_interview'"), (K.AI_KEYWORDS, _ai(low)), (K.SECURITY_KEYWORDS, "'security_appsec'"), (K.DATABASE_KEYWORDS, "'database_engineering'"), (K.BACKEND_KEYWORDS, "'backend_api'"), (K.SYSTEM_KEYWORDS, "'system_design'")])


def classify_import(question: str, answer: str) -> str:
    low = f"lower({question} || chr(10) || {answer})"
    return _first_of(low, [(K.IMPORT_BEHAVIORAL_KEYWORDS, "'behavioral_interview'"), (K.IMPORT_AI_KEYWORDS, _ai(low)), (K.IMPORT_SECURITY_KEYWORDS, "'security_appsec'"), (K.IMPORT_DATABASE_KEYWORDS, "'database_engineering'"), (K.IMPORT_API_KEYWORDS, "'backend_api'"), (K.IMPORT_DESIGN_KEYWORDS, "'system_design'")])


def flavor(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    hits = lambda marks: "(" + " + ".join(f"regexp_matches({low}, '{LEFT}{m}{RIGHT}')::INT" for m in marks) + ")"
    d, p, g = hits(K.DAILY_MARKERS), hits(K.PERSONAL_MARKERS), hits(K.GENERAL_MARKERS)
    return f"(CASE WHEN {d} > 0 THEN 'personal_daily' WHEN {p} > 0 AND {g} > 0 THEN 'mixed' WHEN {g} > 0 THEN 'technical_general' WHEN {p} > 0 THEN 'candidate_specific' ELSE 'mixed' END)"


SCHEME = r"'^[a-zA-Z][a-zA-Z0-9+.-]*://"


def authority(url: str) -> str:
    return rf"regexp_extract(coalesce({url}, ''), {SCHEME}([^/?#]*)', 1)"


def scheme(url: str) -> str:
    return rf"lower(regexp_extract(coalesce({url}, ''), '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"


def path(url: str) -> str:
    return rf"regexp_extract(coalesce({url}, ''), {SCHEME}[^/?#]*([^?#]*)', 1)"


def host(url: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({strip(authority(url))}), '\.+$', ''), '^www\.', '')"


def canonical(url: str) -> str:
    one = f"regexp_replace(CASE WHEN {path(url)} = '' THEN '/' ELSE {path(url)} END, '/+', '/', 'g')"
    return f"(CASE WHEN {scheme(url)} IN ('http', 'https') AND {host(url)} <> '' THEN {scheme(url)} || '://' || {host(url)} || (CASE WHEN {one} = '/' THEN '/' ELSE regexp_replace({one}, '/+$', '') END) ELSE '' END)"


def _mapped(entries: dict, key: str) -> str:
    """A lookup in a constant map; null: not there."""
    return f"map([{listed(map(str, entries))}], [{listed(entries.values())}])[{key}]"


def _character(n: str) -> str:
    from dialogmill.functions.web import _CONTROLS, WINDOWS

    windows = " ".join(f"WHEN {k} THEN chr({ord(v)})" for k, v in WINDOWS.items())
    return f"(CASE {n} {windows} ELSE (CASE WHEN {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN chr(65533) WHEN {n} IN ({', '.join(map(str, _CONTROLS))}) OR {n} BETWEEN 64976 AND 65007 OR {n} % 65536 >= 65534 THEN '' ELSE chr({n}::INT) END) END)"


def unescape(c: str) -> str:
    """Character references decoded once. Only texts with an ampersand that isn't one of the frequent entities are taken apart."""
    from dialogmill.functions.web import BARE, NAMED, PLAIN_ENTITIES

    plain = c
    for entity, char in PLAIN_ENTITIES.items():
        plain = f"replace({plain}, {quoted(entity)}, {quoted(char)})"
    decimal, hexadecimal, bare = "^#([0-9]+);?", "^#[xX]([0-9a-fA-F]+);?", "^(" + "|".join(sorted(BARE, key=lambda x: (-len(x), x))) + ")"
    number = lambda p: f"(CASE WHEN length(ltrim({p}, '0')) > 9 THEN 1073741824 ELSE coalesce(nullif(ltrim({p}, '0'), ''), '0')::BIGINT END)"
    hexed = lambda p: f"(CASE WHEN length(ltrim({p}, '0')) > 9 THEN 1073741824 ELSE ('0x' || coalesce(nullif(ltrim({p}, '0'), ''), '0'))::BIGINT END)"
    named = "regexp_extract(p, '^([^\\t\\n\\f <&#;]{1,32};)', 1)"
    part = (
        f"CASE WHEN regexp_matches(p, '{decimal}') THEN {_character(number(f"regexp_extract(p, '{decimal}', 1)"))} || regexp_replace(p, '{decimal}', '')"
        f" WHEN regexp_matches(p, '{hexadecimal}') THEN {_character(hexed(f"regexp_extract(p, '{hexadecimal}', 1)"))} || regexp_replace(p, '{hexadecimal}', '')"
        f" WHEN {_mapped(NAMED, named)} IS NOT NULL THEN {_mapped(NAMED, named)} || substr(p, length({named}) + 1)"
        f" WHEN regexp_matches(p, '{bare}') THEN {_mapped(BARE, f"regexp_extract(p, '{bare}', 1)")} || substr(p, length(regexp_extract(p, '{bare}', 1)) + 1) ELSE '&' || p END"
    )
    return f"list_transform([{plain}], lambda w: CASE WHEN contains(w, '&') THEN string_split(w, '&')[1] || array_to_string(list_transform(string_split(w, '&')[2:], lambda p: {part}), '') ELSE w END)[1]"


def html_text(c: str) -> str:
    from dialogmill.functions.web import BLOCK_TAGS, TAGS

    c = f"coalesce({c}, '')"
    # that engine has no back-references; a block's first letters tell its name
    blocks = "(?is)" + "|".join(rf"<{tag}.*?>.*?</{tag}>" for tag in BLOCK_TAGS)
    for pattern, out in [(blocks, " "), *TAGS]:
        c = f"regexp_replace({c}, '{pattern}', {'chr(10)' if out == chr(10) else quoted(out)}, 'g')"
    return normalize(rf"regexp_replace({unescape(c)}, '[ \t\f\v\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')")


#: Questions and answers: each user turn with the assistant turn that follows it.
PAIRS = """
pairs AS (
  SELECT conv_id, turn, text AS question, next_text AS answer, turn + 1 AS answer_turn FROM (
    SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')
"""
