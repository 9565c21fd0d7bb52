"""Column functions on inline cases."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialogmill.functions import audio, scoring, similarity, text, web
from dialogmill.operators import turns


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def many(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize(("a", "b", "out"), [("hello wor", "hello world", "hello world"), ("micro-", "phone", "microphone"), ("", "x", "x"), ("x", None, "x"), ("same", "same", "same"), ("long text", "long", "long text")])
def test_merge(spark, a, b, out):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(text.merge(F.col("a"), F.col("b"))).first()[0] == out


def test_normalize(spark):
    assert many(spark, ["a\r\nb", "a\t b", "a\n\n\n\nb", "\xa0x\xa0", None, ""], text.normalize) == ["a\nb", "a b", "a\n\nb", "x", "", ""]


def test_sentences_and_words(spark):
    assert many(spark, ["One. Two! Three?", "no end", "", "...", "A.  B"], text.sentences) == [["One.", "Two!", "Three?"], ["no end"], [], [], ["A.", "B"]]
    assert many(spark, ["it's a-b c", "", None, "é1 _x"], text.word_count) == [2 + 1, 0, 0, 2]


def test_first_person_beside_other_letters(spark):
    assert many(spark, ["éi x", "i x", "I'm", "xi", None, "Our work"], text.first_person) == [False, True, True, False, False, True]


def test_failure_tags_order(spark):
    assert one(spark, "- a\n- b\nAs an AI I can't?", text.failure_tags) == ["too_short", "bullet_only", "ai_disclaimer", "asks_question_back"]


def naive_window(s, most):
    words = lambda x: len(re.findall(r"[\wÀ-ɏ'-]+", x))
    end = lambda x: x if not x or x[-1] in ".!?" else x + "."
    clean = re.sub(r"[ \t]+", " ", s).strip()
    if words(clean) <= most:
        return end(clean)
    kept = []
    for x in [x.strip() for x in re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", clean) if x.strip()]:
        if words(" ".join([*kept, x])) > most:
            break
        kept.append(x)
    return end(" ".join(kept)) if kept else end(" ".join(clean.split()[:most]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?", max_size=60), min_size=10, max_size=10))
def test_word_window_against_loop(spark, texts):
    assert many(spark, texts, lambda c: text.word_window(c, 5)) == [naive_window(s, 5) for s in texts]


def test_speakable(spark):
    long = "We cached the results. " * 20
    got = many(spark, [long, "Short answer", "- a\n- b", None, "Is it?"], lambda c: text.speakable(c, F.lit("Why")))
    assert got[0]["text"].count("We cached") == 20 and not got[0]["rewritten"]
    assert got[1]["text"].startswith("I would explain it this way: short answer") and got[1]["rewritten"]
    assert "\n-" not in got[2]["text"] and got[3]["text"].startswith("I would answer Why by") and not got[4]["text"].endswith("?")


def test_languages_keep_ties_and_substrings(spark):
    assert many(spark, ["the and", "", "ve ile bir", "grün", None], scoring.detect_language) == ["en", "en", "tr", "tr", "en"]


def test_intents(spark):
    got = many(spark, ["What is a transformer?", "Tell me about your experience", "How was your day?", "Explain the cache you built", "x", None], scoring.question_flavor)
    assert got == ["technical_general", "candidate_specific", "personal_daily", "mixed", "mixed", "mixed"]


def test_confidence(spark):
    rows = many(spark, [float("nan"), None, 2.0, -1.0, 0.6], lambda c: scoring.confidence_band(scoring.confidence(c)), "double")
    assert rows == ["medium", "medium", "high", "low", "medium"]


def test_jaccard_of_empty_sets(spark):
    row = spark.createDataFrame([([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>").select(similarity.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r["j"] for r in row] == [0.0, pytest.approx(1 / 3)]


def test_combine_unique(spark):
    assert one(spark, [" A", "a ", "", "b", None, "c"], lambda c: similarity.combine_unique(F.filter(c, lambda x: x.isNotNull()), 2), "array<string>") == [" A", "b"]


def test_html(spark):
    page = "<title> A &amp; B </title><script>x<y</script><p>one<br/>two</p><style>p{}</style>three"
    assert one(spark, page, web.html_text) == "A & B one\ntwo\n three"
    assert spark.createDataFrame([(page, "http://h/x")], "h string, u string").select(web.title(F.col("h"), F.col("u"))).first()[0] == "A & B"


@pytest.mark.parametrize(("url", "out"), [("HTTP://WWW.Ex.com//a//b/?q#f", "http://ex.com/a/b"), ("https://x.org", "https://x.org/"), ("ftp://x.org/a", ""), ("x.org", ""), (None, ""), ("http://x.org./", "http://x.org/")])
def test_canonical(spark, url, out):
    assert one(spark, url, web.canonical) == out


def test_links(spark):
    page = """<a href="/a">x</a><a href='b'>y</a><a href="#t"></a><a href="//c.org/z"></a><a href="http://d.org"></a>"""
    rows = spark.createDataFrame([(page, "https://www.base.org/dir/page")], "h string, u string").select(F.explode(web.links(F.col("h"))).alias("x"), "u")
    assert {r[0] for r in rows.select(web.canonical(web.absolute(F.col("x"), F.col("u")))).collect()} == {"https://base.org/a", "https://base.org/dir/b", "https://c.org/z", "http://d.org/"}


def test_flush_delay(spark):
    f = lambda s, now: spark.range(1).select(turns.flush_delay(F.lit(s), F.lit(2000), F.lit(now), 320, 1300, 5200)).first()[0]
    assert (f("So?", 2200), f("and then", 7200), f("and then", 2200)) == (320, 0, 1300)


def test_pcm(spark):
    samples = [0, 1, -1, 32767, -32768, 300]
    row = spark.createDataFrame([(samples,)], "x array<int>").select(audio.pcm16(audio.pack_pcm16(F.col("x"))).alias("s"), audio.rms(audio.pack_pcm16(F.col("x"))).alias("r")).first()
    assert row["s"] == samples and row["r"] == pytest.approx(math.sqrt(sum(x * x for x in samples) / 6))
    assert spark.range(1).select(audio.rms(F.lit(b""))).first()[0] == 0.0


def test_texts_without_patterns_for_blanks(spark):
    white = [chr(i) for i in range(0x3001) if re.fullmatch(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", chr(i))]
    odd = ["".join(white) + "a b" + "".join(reversed(white)), "\x1c\u200b x \u180e\ufeff", "a \t\tb\t c\r\r\n\n\n\nd  \n", " \n", "\u212a2z ABC-d/e+f a1 Abc-D/e+F", "x" * 2599 + " y", "é_" * 1400 + " z", " ".join(map(str, range(300))), None]
    for i, x in enumerate(odd):
        odd[i] = x and x * (1 + i % 2)
    old = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    whole = lambda c: F.coalesce(c, F.lit(""))
    assert many(spark, odd, lambda c: text.strip(whole(c))) == many(spark, odd, lambda c: old(whole(c)))
    plain = lambda c: old(F.regexp_replace(F.regexp_replace(F.regexp_replace(whole(c), "\r\n", "\n"), "[ \t]+", " "), "\n{3,}", "\n\n"))
    assert many(spark, odd, text.normalize) == many(spark, odd, plain)
    assert many(spark, odd, text.tokens) == many(spark, odd, lambda c: F.array_distinct(F.transform(F.regexp_extract_all(plain(c), F.lit(r"[A-Za-z][A-Za-z0-9_+\-/]{2,}"), F.lit(0)), F.lower)))
    assert many(spark, odd, text.token_set) == many(spark, odd, lambda c: F.array_distinct(F.slice(F.regexp_extract_all(F.lower(whole(c)), F.lit(r"[A-Za-z0-9_\-À-ɏ]+"), F.lit(0)), 1, 260)))


def test_word_window_takes_whole_sentences(spark):
    rows = ["One two three. Four five! Six seven eight nine. Ten.", "a b c d e f g h", "It's over-long here now. x", "... !!! a. b. c. d. e. f.", None, ""]
    want = ["One two three. Four five!", "a b c d e.", "It's over-long here now. x.", None, "", ""]
    got = many(spark, rows, lambda c: text.word_window(c, 5))
    assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]


def test_token_sets_are_computed_once(spark, sf_dir):
    from dialogmill.plans import registry

    plan = registry.QUERIES["token_sets"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # the technical tokens, and the token set of the head and of the whole text
    assert plan.count("regexp_extract_all") == 3 and "array_sort" not in plan


def test_levels_beyond_16_bits(spark, tmp_path):
    import duckdb
    from compare import differences

    from dialogmill.plans import registry

    wide = [0, -1, 32768, 40000, -(1 << 31), (1 << 31) - 1]
    assert spark.createDataFrame([(wide,)], "x array<int>").select(audio.pcm32(audio.pack_pcm32(F.col("x")))).first()[0] == wide
    values = [0.0, 1.26, 546.1, 546.2, 700.5, 2400.0, -999.9, 1e6, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert differences(registry.QUERIES["rms_level"](spark, str(tmp_path)), registry.SQL["rms_level"], con) is None


def test_character_references_are_those_of_the_standard(spark):
    import html
    import random

    from dialogmill.functions import web
    from dialogmill.plans import sql as q

    rng = random.Random(3)
    bits = ["&", "amp;", "&amp;", "&lt", "&nbsp;", "&notit;", "&#8217;", "&#x2019;", "&#128;", "&#0;", "&#xD800;", "&#99999999999999;", "&#11;", "&eacute;", "&eacute", "&hellip;", "x", " ", "&copyx;", "&#", "&#x;", "&;", "&fjlig;", "&#000065;", "&#x10FFFF;", "&#x1F600;", "&bogus;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(400)] + ["&" + n for n in [*web.NAMED][::40]] + ["&" + n + "z" for n in web.BARE]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", web.unescape(F.col("s")).alias("u"))
    assert {r["i"]: r["u"] for r in got.collect()} == {i: html.unescape(x) for i, x in enumerate(texts)}
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    assert dict(con.execute(f"SELECT i, {q.unescape('s')} FROM t").fetchall()) == {i: html.unescape(x) for i, x in enumerate(texts)}


def test_url_policies_at_their_edges(spark):
    from dialogmill.functions import web

    rows = spark.createDataFrame([("http://a.org/X1",), ("http://a.org/ab",)], "u string")
    flags = lambda c: [r[0] for r in rows.select(c).collect()]
    assert flags(web.excluded(F.col("u"), [r"/\D\D$", "["])) == [False, True] and flags(web.excluded(F.col("u"), ["/x1$"])) == [True, False] and flags(web.excluded(F.col("u"), ["["])) == [False, False]
    assert web.usable_patterns(["a", "["])[0] == ["a"] and web.usable_patterns(["["])[1][0].startswith("invalid_pattern:[:")
    assert flags(web.matches_domain(web.host(F.col("u")), [])) == [True, True] and flags(web.matches_domain(web.host(F.col("u")), [], empty=False)) == [False, False]


def test_html_blocks_end_at_their_own_tag(spark):
    from dialogmill.functions import web

    cases = {"<noscript><script>x</noscript> visible </script> end": "visible end", "a <SCRIPT src=1>b</script > c</Script> d": "a d", "<style>x</style>y<script>z": "y z"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "html string, want string")
    assert [r for r in rows.select(web.html_text(F.col("html")).alias("got"), "want").collect() if r["got"] != r["want"]] == []


def test_take_counts_keep_the_ratios():
    import itertools

    from dialogmill.operators.quota import take_counts

    for web, session, glossary in itertools.product((0, 1, 7, 100), repeat=3):
        for r_web, r_session, r_glossary in itertools.product((0.0, 0.3, 0.7, 1.0), (0.0, 0.2, 0.5), (0.0, 0.25, 1.0)):
            got = take_counts(web, session, glossary, r_web, r_session, r_glossary)
            total = sum(got.values())
            assert got["web_corpus"] <= web and got["session"] <= session and got["glossary"] <= glossary
            if r_web + r_session <= 1 and web and session and total > 30:
                assert got["web_corpus"] >= r_web * total - 1 and got["session"] >= r_session * total - 1 and got["glossary"] <= r_glossary * total + 1


def test_texts_are_taken_as_they_are_where_blanks_dont_matter(spark):
    odd = ["I\t \tsaid:\r\r\n\n\n\nas  an\tAI  ", " \xa0we've ", "xi İ", "as\n an ai", "\r\r\n. . a. b\n\n\nc. d. e. f", "One. Two. Three. Four. Five", ". . . ", "x" * 900, "a.b", None, "", "- a\r\r\n- b\r\r\nmodel  language"]
    whole = lambda c: text.normalize(c)
    assert many(spark, odd, text.word_count) == many(spark, odd, lambda c: F.size(F.regexp_extract_all(whole(c), F.lit(text.WORD), F.lit(0))))
    for terms in (text.K.FIRST_PERSON, text.K.AI_DISCLAIMERS):
        assert many(spark, odd, lambda c: text.has_word(c, terms)) == many(spark, odd, lambda c: F.lower(whole(c)).rlike(f"{text.LEFT}({text.any_of(terms)}){text.RIGHT}"))  # noqa: B023
    assert many(spark, odd, lambda c: text.again(whole(c))) == many(spark, odd, lambda c: whole(whole(c)))

    def summary(c):
        parts = F.filter(F.transform(F.split(F.replace(whole(c), F.lit("\n"), F.lit(" ")), r"\. ", -1), text.strip), lambda s: s != "")
        base = text.strip(F.array_join(F.slice(parts, 1, 4), ". "))
        return F.concat(F.lit("T. "), F.when(base == "", F.substring(whole(c), 1, 720)).otherwise(base))

    assert many(spark, odd, lambda c: text.corpus_summary(c, F.lit("T"))) == many(spark, odd, summary)
    terms = sorted({x for name in dir(text.K) if name.endswith("KEYWORDS") for x in getattr(text.K, name)})
    assert not re.search(r"[][()+*?|^${}\\]", "".join(terms))
    pairs = [f"x{x}y" for x in terms] + ["", "plain", None]
    assert many(spark, pairs, lambda c: text.has_any(c, terms)) == many(spark, pairs, lambda c: c.rlike(text.any_of(terms)))


def test_pairs_of_an_import_are_found_once(spark):
    """A filter on a column puts its expression in for it, so each test of a pair ran the patterns over the whole text again."""
    from dialogmill.operators import imports as im

    rows = spark.createDataFrame([("\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nHuman: d\n\nAssistant:\n\nHuman: e",), ("\n\nHuman: a",), (None,)], "text string")
    last = rows.select(im.last_exchange(F.col("text")).alias("x"))
    assert [r["x"] and tuple(r["x"]) for r in last.collect()] == [("c\n\nHuman: d", "Human: e"), None, None]
    plan = im.import_rows(last.where("x IS NOT NULL").select("x.*"), "dialogues")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(im.EXCHANGE) <= 6  # the pattern and two groups, in the filter and in the column
