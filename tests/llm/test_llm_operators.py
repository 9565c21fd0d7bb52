"""The training-data operators against brute force, libraries and their SQL."""

import hashlib
import io
import random
import tarfile
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import differences, duck
from pyspark.sql import functions as F

from dialogmill.llm import bpe, common, line_dedup, media, mixing, quality_rules, sharding, simhash, token_counts, url_filter, weak_label
from dialogmill.llm.queries import QUERIES, SQL

DOC = "doc_id long, text string, source string"
LONG = "wörd%d " * 3000 % tuple(range(3000))
#: Nulls in each column, empty and blank texts, copies, repeated rows, a long text.
EDGES = [(0, "a b c d e f " * 20, "x"), (1, None, "x"), (2, "", None), (3, " \n\t\n ", "y"), (4, LONG, "y"), (5, "a b c d e f " * 20, "x"), (5, "a b c d e f " * 20, "x"), (None, "lost id\nlost id", "z"), (6, "one", "z"), (7, "one two", "z"), (8, "x" * 5000, "z")]


@pytest.fixture(scope="module")
def edges(spark):
    rows = spark.createDataFrame([(*r, "extra") for r in EDGES], DOC + ", n_words string")
    return rows.withColumn("shard", F.lit(-1)).withColumn("kept", F.lit("?")).withColumn("fp", F.lit(0)).withColumn("block", F.lit(9))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), SQL[name], duck(sf_dir)) is None


def words(text):
    return (text or "").encode().lower().split()


# --- quality rules


def test_quality_rules_edges(edges, nothing):
    got = quality_rules.quality_rules(edges).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[0]["n_repeat_words"] == 120 and by[0]["base_failed"] and by[4]["n_words"] == 3000 and not by[4]["base_failed"]
    assert quality_rules.quality_rules(nothing).count() == 0


def test_rules_are_ordered_by_rejections_per_second():
    a, b, c = quality_rules.RULES[:3]
    assert quality_rules.order([(a, 2.0, 0.5), (b, 1.0, 0.5), (c, 0.1, 0.0)]) == [b, a, c]


def test_order_does_not_change_the_verdict(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    stats = quality_rules.base_statistics(docs)
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        got = {r[0]: r[1] for r in stats.select("doc_id", quality_rules.cascade(rules, quality_rules.base_failed()).alias("k")).collect()}
        assert got == {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}


# --- mixing


def test_mixing_budgets(spark):
    rows = [(i, "w " * 10, "big") for i in range(90)] + [(100 + i, "w " * 10, "small") for i in range(10)] + [(200, None, "none"), (201, "w", None)]
    out = mixing.mix(spark.createDataFrame(rows, DOC), max_repeats=3.0).collect()
    used, blocks = Counter(r["source"] for r in out), defaultdict(set)
    for r in out:
        assert (r["doc_id"], r["block"]) not in blocks[r["source"]]
        blocks[r["source"]].add((r["doc_id"], r["block"]))
    assert used["big"] == 90 and used["none"] == 1 and used[None] in (2, 3)  # floor of a hair below three
    assert 10 <= used["small"] <= 30 and {r["doc_id"] for r in out} == {r[0] for r in rows}


def test_mixing_entropy(spark):
    rows = [(i, "w " * 10, "big") for i in range(90)] + [(100 + i, "w " * 10, "small") for i in range(10)]
    budgets = mixing.source_budgets(mixing.source_tokens(spark.createDataFrame(rows, DOC)), None, 0.6).collect()
    w = [r["weight"] for r in budgets]
    assert -sum(x * np.log(x) for x in w) == pytest.approx(0.6, abs=1e-4)


def test_largest_source_makes_a_whole_pass_at_any_size(spark):
    """Rounding of weight * budget grows with the tokens; the largest source must not lose its last document."""
    for most in range(20_000_000_003, 20_000_000_011):
        rows = [("big", 10, most)] + [(f"s{i}", 10, most // (3 * i + 2) + 7 * i) for i in range(12)]
        got = {r["source"]: r for r in mixing.source_budgets(spark.createDataFrame(rows, "source string, n_docs long, tokens long")).collect()}
        assert got["big"]["full"] == 1 and got["big"]["budget"] >= most


def test_mixing_edges(edges, nothing):
    out = mixing.mix(edges)
    assert out.columns[: len(edges.columns) - 1] == [c for c in edges.columns if c != "block"]
    got = Counter(r["doc_id"] for r in out.collect())
    assert set(got) == {r[0] for r in EDGES} and got[5] % 2 == 0
    assert mixing.mix(nothing).count() == 0


# --- line dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def naive_lines(docs, least):
    """doc_id -> kept text, for distinct ids without nulls."""
    firsts, order = {}, []
    for i, text in sorted(docs):
        for at, line in enumerate(text.split("\n")):
            if line.encode().split() and line not in firsts:
                firsts[line] = (i, at)
                order.append(line)
    gone = {b for k, b in enumerate(order) if len(b) >= least and any(len(a) >= least and within_one(a, b) for a in order[:k])}
    return {i: "\n".join(x for at, x in enumerate(text.split("\n")) if not x.encode().split() or (firsts[x] == (i, at) and x not in gone)) for i, text in docs}


@pytest.mark.parametrize("least", [1, 20])
def test_line_dedup_against_brute_force(spark, least):
    rng = random.Random(5)
    base = ["".join(rng.choice("abé😀 ") for _ in range(n)) for n in (1, 2, 3, 7, 19, 20, 21, 40, 255, 256, 257, 258, 511, 512, 513, 514, 700) for _ in range(2)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            line = rng.choice(base)
            at, kind = rng.choice([0, len(line) - 1, rng.randrange(len(line)), 255, 256]) % len(line), rng.randrange(5)
            lines.append([line, line[:at] + line[at + 1 :], line[:at] + rng.choice("abz") + line[at + 1 :], line[:at] + "z" + line[at:], line[:at] + "zz" + line[at:]][kind])
        docs.append((i, "\n".join([*lines, "", "end."])))
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), least)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == naive_lines(docs, least)


def test_line_dedup_sql_loses_no_pair_by_halves(sf_dir):
    con = duck(sf_dir)
    con.sql("CREATE OR REPLACE VIEW documents AS SELECT doc_id, left(text, 3000) AS text FROM read_parquet('" + f"{sf_dir}/documents.parquet" + "')")
    assert sorted(con.sql(line_dedup.op3_sql()).fetchall()) == sorted(con.sql(line_dedup.op3_sql(halves=False)).fetchall())


def test_line_dedup_long_lines(spark):
    """The cost of a line grows with its length, not with its square."""
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefgh ", k=1_000_000))
    rows = [(1, line), (2, line[:700_000] + line[700_001:]), (3, line[:5] + "Z" + line[6:]), (4, line[:-2])]
    began = time.perf_counter()
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: line, 2: "", 3: "", 4: line[:-2]}
    assert time.perf_counter() - began < 60


def test_line_dedup_edges(edges, nothing):
    out = line_dedup.line_dedup(edges).collect()
    assert len(out) == len(EDGES) and set(edges.columns) <= set(out[0].asDict())
    by = {r["doc_id"]: r for r in out}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[3]["text"] == " \n\t\n " and by[5]["text"] == "" and by[None]["text"] == "lost id" and by[4]["text"] == LONG
    assert (by[None]["n_lines"], by[None]["n_kept"]) == (2, 1)
    assert line_dedup.line_dedup(nothing).count() == 0


# --- url filter


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/de/x", "example.net", "/de/x", "net/", "block"), ("http://net", "net", "", None, "allow"), ("http://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://casino.org#f/", "casino.org", "", None, "block"), ("http://casinos.org/", "casinos.org", "/", None, "allow"), ("http://a.org/cheap/cheap", "a.org", "/cheap/cheap", None, "allow"), ("http://a.org/cheap-win", "a.org", "/cheap-win", None, "block"),
    ("no scheme casino", "", "", None, "block"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://É.com/de/", "É.com", "/de/", None, "allow"),
])
def test_url_verdicts(url, host, path, rule, verdict):
    assert url_filter.UrlJudge(url_filter.UrlPolicy()).verdict(url)[:4] == (host, path, rule, verdict)


def test_url_vocabulary_of_a_table(spark):
    terms = spark.createDataFrame([("Foo", "strict"), (" bar ", "soft"), ("baz", "soft"), ("", "soft"), (None, "strict")], "term string, kind string")
    policy = url_filter.load_vocabulary(terms, min_soft=2)
    assert (policy.strict, policy.soft) == (["foo"], ["bar", "baz"])
    judge = url_filter.UrlJudge(policy)
    assert [judge.verdict(f"http://a.org/{x}")[3] for x in ("foo", "bar", "bar-baz", "food", "casino")] == ["block", "allow", "block", "allow", "allow"]
    with pytest.raises(ValueError, match="kinds"):
        url_filter.load_vocabulary(spark.createDataFrame([("x", "odd")], "term string, kind string"))


def test_long_url():
    url = "http://a.org/" + "free-" * 200_000 + "win"
    assert url_filter.UrlJudge(url_filter.UrlPolicy()).verdict(url)[3] == "block"


def test_url_filter_tables(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://spam.org", "x")], "page_id long, url string, host string")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in url_filter.url_filter(rows).collect()) == [(0, "block"), (1, "allow"), (1, "allow")]
    assert url_filter.url_filter(rows.limit(0)).count() == 0


# --- sharding


def law_holds(rows, n_docs, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(n_shards)]
    assert len(rows) == n_docs and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n_shards))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_sharding_law_and_cuts(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    law_holds(rows, docs.count(), 24)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode()))
        groups[texts[r["doc_id"]]].append(r["shard"])
    cut = sum(len(s) - max(Counter(s).values()) for s in groups.values())
    assert cut <= 0.2 * sum(len(s) - 1 for s in groups.values() if len(s) > 1)


def test_sharding_when_all_are_linked_or_one_group_is_larger_than_a_shard(spark):
    for rows in ([(i, "same") for i in range(101)], [(i, str(i // 2)) for i in range(200)], [(i, "hot" if i % 3 == 0 else str(i)) for i in range(300)]):
        law_holds(sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect(), len(rows), 7)


def test_sharding_gathers_a_hot_group(spark):
    """A third of the rows in one group and many pairs: no refused unit holds up what fits."""
    n = 12000
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 and i < n // 2 else f"own {i}") for i in range(n)]
    rows = [(i, f"pair {i // 6 % 500}" if i % 3 == 1 and i < n // 2 else t) for i, t in rows]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    law_holds(got, n, 24)
    hot = [r["shard"] for r in got if r["doc_id"] % 3 == 0]
    assert len(hot) == n // 3
    share = sum((hot.count(s) / len(hot)) ** 2 for s in set(hot))
    print("same-shard share", share, "shards", len(set(hot)))
    assert share > 0.1 and sorted(map(hot.count, set(hot)))[-8:][0] > 300


def test_sharding_edges(edges, nothing):
    law_holds(sharding.shard_rows(edges).collect(), len(EDGES), 24)
    assert sharding.shard_rows(nothing).count() == 0


# --- quality classifier


def test_classifier_held_out_accuracy(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op6_quality_classifier"](spark, sf_dir).collect()}
    assert np.mean([got[i] == bool(q) for i, q in labels.items()]) >= 0.95


def test_expectation_maximisation_finds_the_accurate_labeller():
    rng = random.Random(1)
    counts = Counter()
    for _ in range(3000):
        good = rng.random() < 0.7
        vote = lambda right: 1 if (rng.random() < right) == good else 2
        counts[sum(v * 3**j for j, v in enumerate((vote(0.95), vote(0.8), vote(0.6))))] += 1
    post, theta = weak_label.expectation_maximisation(counts, 3)
    assert theta[1, 0, 1] > theta[1, 1, 1] > theta[1, 2, 1] and post[1 + 3 + 9] > 0.95 and post[2 + 6 + 18] < 0.1


def plain_posterior(rows, n, rounds=50):
    """Expectation-maximisation over every row's votes, with plain sums; starts like the operator."""
    import math

    post = [0.1 if sum(v == 2 for v in r[: n - 1]) >= max(1, sum(v == 1 for v in r) - 1) else 0.9 for r in rows]
    for _ in range(rounds):
        theta = [[[0.5] * 3 for _ in range(n)] for _ in range(2)]
        for r, p in zip(rows, post):
            for j, v in enumerate(r):
                theta[0][j][v] += 1 - p
                theta[1][j][v] += p
        theta = [[[x / sum(t) for x in t] for t in c] for c in theta]
        prior = min(0.95, max(0.05, sum(post) / len(post)))
        log = [[math.log(q) + sum(math.log(theta[c][j][v]) for j, v in enumerate(r)) for r in rows] for c, q in ((0, 1 - prior), (1, prior))]
        post = [1 / (1 + math.exp(min(50, max(-50, a - b)))) for a, b in zip(*log)]
    return post


def test_classifier_against_a_plain_version(spark, sf_dir):
    """Votes of all documents, the model's labels and weights, and every document's score, computed anew in plain Python."""
    import math

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    n = len(weak_label.labellers())
    voted = weak_label.votes(docs).select("doc_id", "pattern", F.xxhash64("text").alias("h")).collect()
    some = [r for r in voted if r["pattern"] >= 0]
    post = plain_posterior([[r["pattern"] // 3**j % 3 for j in range(n)] for r in some], n)
    labels = {}
    for good in (1.0, 0.0):
        side = sorted({r["h"] for r, p in zip(some, post) if (p if good else 1 - p) >= weak_label.CLEAR})
        labels |= dict.fromkeys(side[: weak_label.TRAIN_DOCS // 2], good)
    assert set(labels.values()) == {0.0, 1.0}
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {r["h"]: by_id[r["doc_id"]] for r in voted}
    x, y = np.zeros((len(labels), (1 << weak_label.BITS) + 2)), np.array([labels[h] for h in sorted(labels)])
    for k, h in enumerate(sorted(labels)):
        words = texts[h].encode().split()
        for w in words:
            for b in weak_label.buckets(w.decode()):
                x[k, b] += 1 / len(words)
        x[k, -2], x[k, -1] = sum(a == b for a, b in zip(words, words[1:])) / len(words), 1
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    each = np.where(y > 0.5, 0.5 / (y > 0.5).sum(), 0.5 / (y <= 0.5).sum())
    for _ in range(150):
        grad = ((1 / (1 + np.exp(-(x @ w))) - y) * each) @ x
        grad[:-1] += 1e-5 * w[:-1]
        seen += grad * grad
        w -= 0.4 * grad / np.sqrt(seen)
    differ = 0
    for r in QUERIES["op6_quality_classifier"](spark, sf_dir).collect():
        words = by_id[r["doc_id"]].encode().split()
        z = sum(w[b] for v in words for b in weak_label.buckets(v.decode())) / len(words) + w[-2] * sum(a == b for a, b in zip(words, words[1:])) / len(words) + w[-1] if words else -math.inf
        want = 1 / (1 + math.exp(-max(-50, z))) if words else 0.0
        assert r["quality_score"] == pytest.approx(want, abs=2e-3)
        differ += r["kept"] != (want >= weak_label.THRESHOLD)
    assert differ <= 1


def test_classifier_always_trains(spark):
    """Where all patterns are on one side, the model still scores."""
    docs = spark.createDataFrame([(i, "the plan of the team is to ship it on time, and it is good to do it well for all of us") for i in range(5)], "doc_id long, text string")
    weights, post = weak_label.fit(docs)
    assert len(weights) == (1 << weak_label.BITS) + 2 and weights.any() and all(p >= 0.5 for p in post.values())
    assert weak_label.nearest({0: 0.6, 1: 0.7, 2: 0.3}, True) == [1] and weak_label.nearest({0: 0.6, 1: 0.7, 2: 0.3}, False) == [2] and weak_label.nearest({0: 0.6}, False) == []


def test_classifier_edges(edges, nothing, spark):
    out = weak_label.classify(edges).collect()
    assert len(out) == len(EDGES) and not next(r for r in out if r["doc_id"] == 1)["kept"]
    assert weak_label.classify(nothing).count() == 0
    alike = spark.createDataFrame([(i, "The cat sat on the mat and it was happy to be there.") for i in range(3)], "doc_id long, text string")
    assert all(r["kept"] for r in weak_label.classify(alike).collect())


# --- byte-pair encoding and counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))


def test_bpe_equals_the_library(library):
    own, rng = bpe.WordBpe(bpe.tokenizer_path(bpe.TOKENIZER)), random.Random(2)
    bits = ["a", "B", "'s", "'LL", " ", "\n", "\x1c", "\x85", "\x01", "1", "23", "é", "e\u0301", "Σ", "İ", "<|endoftext|>", "<|startoftext|>", "</w>", "<|", "…", "漢字", "😀", "\u200d", "ing", "$%", "\u3000", "\u0558", "ẞ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)] + ["".join(rng.choice("abcdefgh") for _ in range(5000)), LONG]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries_lie_inside_no_token():
    own = bpe.WordBpe(bpe.tokenizer_path(bpe.TOKENIZER))
    assert len(own.cut(own.symbols("qzjx!#q"))) > 1 and b"".join(x.encode() for f in own.cut(own.symbols("hello")) for x in f) == b"hello</w>"


def test_bpe_query_and_counts(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, sf_dir, "documents").collect()}
    counts = {r["doc_id"]: r for r in QUERIES["op8_token_counts"](spark, sf_dir).collect()}
    for r in QUERIES["op7_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) == counts[r["doc_id"]]["n_tokens"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[r["doc_id"]]["over_limit"] == (len(ids) > 2048) and counts[r["doc_id"]]["n_bytes"] == len(texts[r["doc_id"]].encode())


def test_encoding_edges(edges, nothing):
    own = {r["doc_id"]: r for r in bpe.encode(edges).collect()}
    assert own[1]["ids"] == own[2]["ids"] == [] and own[1]["decoded"] == ""
    assert bpe.encode(edges).count() == len(EDGES) == token_counts.token_counts(edges).count()
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(edges, table_rows=2).collect()} == {i: len(r["ids"]) for i, r in own.items()}
    assert bpe.encode(nothing).count() == token_counts.token_counts(nothing).count() == 0


def test_counts_of_a_sentencepiece_model(edges):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=bpe.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(edges, "piece_bpe_32k.model").collect()}
    assert got == {i: len(model.encode(t or "")) for i, t, _ in EDGES}


def test_counts_of_a_byte_level_tokenizer(spark, edges):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(edges, "byte_bpe_50k.json").collect()}
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t, _ in EDGES}
    with pytest.raises(ValueError, match="word ends"):
        bpe.WordBpe(path)
    with pytest.raises(ValueError, match="neither"):
        token_counts.token_counts(edges, "byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_of_random_texts(name):
    from tokenizers import Tokenizer

    path, rng = bpe.tokenizer_path(name), random.Random(9)
    own = Tokenizer.from_file(path)
    bits = ["a", "B", "'s", " ", "  ", "\n", "\x1c", "\x85", "\x01", "12", "é", "e\u0301", "İ", "<|endoftext|>", "<|", "漢字", "😀", "\u200d", "ing", "$%", "\u3000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(600)] + [LONG * 30]
    counter = token_counts.kind_of(path)(path, {"a": 1} if name[0] == "w" else {}, cache=500)
    assert counter.counts(texts[:300]) + counter.counts(texts[300:]) == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


# --- media


def test_media_round_trip(spark, edges, nothing, tmp_path):
    rows = media.store(edges, f"file://{tmp_path}/m", shard_bytes=20_000).persist()  # one run of the writing tasks
    got = media.read_back(media.with_headers(rows)).collect()
    assert len(got) == len(EDGES)
    texts = {i: t for i, t, _ in EDGES}
    for r in got:
        payload, n = media.payload_of(texts[r["doc_id"]])
        assert r["n_bytes"] == n and r["payload_bytes"] == len(payload) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["width"], r["height"], r["depth"]) == (64, len(payload) // 64, 8)
        with open(r["shard"].removeprefix("file://"), "rb") as f:
            data = f.read()
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            assert tar.extractfile(f"{r['digest']}.png").read() == data[r["offset"] : r["offset"] + r["length"]]
    assert media.store(nothing).count() == 0


def test_media_query(spark, sf_dir):
    """Every column of the query, against the texts alone."""
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op9_media"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    by_text = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        lines = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
        chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
        steps = sum(abs(x - y) for x, y in zip(payload, payload[1:]))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and (r["width"], r["height"]) == (64, len(payload) // 64)
        assert r["media_bytes"] == len(png) and r["media_sha256"] == hashlib.sha256(png).hexdigest()
        assert r["feature"] == f"h{len(payload) // 64}-s{sum(payload)}-d{len(set(payload))}-g{steps}"
        assert by_text.setdefault(texts[r["doc_id"]], tuple(r)[1:]) == tuple(r)[1:]


@pytest.mark.parametrize("copies", [media.COPIES, 1])
def test_manifest_writes_each_text_once(spark, edges, tmp_path, monkeypatch, copies):
    import os

    monkeypatch.setattr(media, "COPIES", copies)
    docs = edges.unionByName(edges.where("doc_id = 4 OR doc_id IS NULL")).repartition(5)
    places, keys = media.manifest(docs, f"file://{tmp_path}/m")
    first = sorted(os.listdir(tmp_path / "m"))
    members = [m.name for f in first for m in tarfile.open(tmp_path / "m" / f).getmembers()]
    texts = {t or "" for _, t, _ in EDGES}
    assert len(members) == len(set(members)) == len(texts) == places.count()
    got = keys.join(media.read_back(media.with_headers(places)).drop("doc_id"), "key").collect()
    assert Counter((r["doc_id"], r["payload_sha256"]) for r in got) == Counter((r["doc_id"], hashlib.sha256(media.payload_of(r["text"])[0]).hexdigest()) for r in docs.collect())
    assert sorted(os.listdir(tmp_path / "m")) == first
    none, keys = media.manifest(edges.limit(0), f"file://{tmp_path}/n")
    assert none.count() == keys.count() == 0


def test_damaged_media_is_noticed():
    data = bytearray(media.to_png(b"x" * 64))
    assert media.from_png(bytes(data)) == b"x" * 64
    data[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(data))


# --- simhash


def naive_fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(prints):
    """doc_id -> smallest reachable id, for (doc_id, fp)."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if bin(a ^ b).count("1") <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def test_simhash_query_against_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    prints = [(r["doc_id"], naive_fingerprint(r["text"])) for r in docs]
    want = naive_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in prints}


def test_covering_masks_see_every_pair():
    rng = random.Random(4)
    for n in (1, 2, 3):
        for _ in range(500):
            diff = sum(1 << b for b in rng.sample(range(64), n))
            t = next(i for i, m in enumerate(simhash.FIRST) if not diff & m)
            assert any(not diff & m for m in simhash.free_masks()[t])


@pytest.mark.parametrize("most", [4096, 3])
def test_links_connect_clusters(spark, most):
    """With a small limit every bucket takes the second masks."""
    rng, fps = random.Random(6), set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            if rng.random() < 0.7:
                x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
    prints = sorted((f - (1 << 64) if f >> 63 else f) for f in fps)
    want = naive_components([(f, f & (2**64 - 1)) for f in prints])
    star = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in prints], "fp long"), most))
    got = {r["node"]: r["root"] for r in star.collect()}
    assert {f: got.get(f, f) for f in prints} == want


def test_simhash_edges(edges, nothing):
    got = {r["doc_id"]: r for r in simhash.near_components(edges).collect()}
    assert got[1]["fp"] == got[2]["fp"] == got[3]["fp"] == 0 and got[3]["component_id"] == 1
    assert got[5]["component_id"] == 0 and simhash.near_components(edges).count() == len(EDGES)
    assert simhash.near_components(nothing).count() == 0
