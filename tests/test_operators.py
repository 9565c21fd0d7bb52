"""Relational operators against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dialogmill.functions import constants as K
from dialogmill.operators import chunks, dpo, near_dup, percentiles, quota, turns
from dialogmill.plans import dataset_queries as dq
from dialogmill.sources.sessions import replace_sources
from dialogmill.streaming.run import shared_folder


@pytest.fixture(autouse=True)
def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(shared_folder(spark))


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_similar_pairs_and_resolutions(spark):
    rng = random.Random(3)
    base = [{rng.choice("abcdefghijklmnop") for _ in range(8)} for _ in range(12)]
    sets = {i: set(rng.choice(base)) ^ ({rng.choice("abcdefghijklmnop")} if rng.random() < 0.7 else set()) for i in range(60)} | {60: set()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id long, tokens array<string>")
    classes = near_dup.set_classes(df)
    firsts = {r["first"] for r in classes.collect()}
    want = {(a, b) for a in firsts for b in firsts if a < b and jac(sets[a], sets[b]) >= 0.7}
    pairs = near_dup.similar_pairs(classes, 0.7)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert {r[0] for r in near_dup.resolve_any(pairs).collect()} == {b for _, b in want}
    kept, gone = [], set()
    for x in sorted(firsts):
        if any((k, x) in want for k in kept):
            gone.add(x)
        else:
            kept.append(x)
    assert {r[0] for r in near_dup.resolve_greedy(pairs).collect()} == gone


def test_an_index_for_some_tokens_has_these_alone(spark):
    rows = [("s", i, "note", 0, [f"w{i % 3}", f"own{i}"]) for i in range(12)]
    chunked = spark.createDataFrame(rows, "source_id string, chunk_no int, source_type string, updated_ms long, tokens array<string>")
    places = lambda df: {(r["tok"], p["chunk_no"], r["df"]) for r in df.collect() for p in r["places"]}
    whole = places(chunks.postings(chunked))
    some = places(chunks.postings(chunked, tokens=spark.createDataFrame([("w1",), ("own4",), ("none",)], "tok string")))
    assert len(whole) == 24 and some == {x for x in whole if x[0] in ("w1", "own4")} and len(some) == 5


def test_few_pairs_fetch_their_tokens(spark):
    rng = random.Random(5)
    # each set shares its rarest token with all of its group, and only copies with a word changed are similar
    sets = {i: {f"rare{i % 3}"} | {f"w{rng.randrange(3000)}" for _ in range(60)} for i in range(90)}
    sets |= {100 + i: (sets[i] - {min(sets[i])}) | {"other"} for i in range(0, 90, 9)} | {300: set(), 301: {"alone"}}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items() if s], "first long, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and jac(sets[a], sets[b]) >= 0.84}
    assert len(want) == 10
    for most in (0, 40, 500_000):
        index = near_dup.prefixes(df, 0.84, most)
        some = {(r["a"], r["b"]) for r in near_dup.likely(index, index, 0.84, once=True).collect()}
        assert want <= some and len(some) < 20
        assert {(r["a"], r["b"]) for r in near_dup.matched(index, index, df, 0.84, once=True).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 5, 20, 101])
def test_percentiles(spark, n):
    import math

    values = [float((i * 37) % 50) for i in range(n)]
    s = sorted(values)
    row = percentiles.ranked_values(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v", {"a": percentiles.nearest_place(0.95), "b": percentiles.floor_place(0.95), "c": percentiles.upper_place()}).first()
    assert (row["a"], row["b"], row["c"], row["count"]) == (s[math.ceil(n * 0.95) - 1], s[max(0, int(n * 0.95 - 1))], s[n // 2], n)


def test_percentile_examples(spark):
    rows = spark.createDataFrame([("k", float(v)) for v in (100, 20, 300, 80, 50)], "k string, v double")
    places = {"p50": percentiles.nearest_place(0.5), "p95": percentiles.nearest_place(0.95)}
    row = percentiles.ranked_values(rows, ["k"], "v", places).first()
    assert (row["p50"], row["p95"]) == (80, 300)
    assert percentiles.ranked_values(rows.where("v < 0"), ["k"], "v", places).count() == 0


def test_percentiles_of_many_ranges(spark):
    """Groups of all sizes, a null key, nulls, equal values and a skewed spread, against sorting."""
    rng = random.Random(4)
    rows = [(k, rng.choice([None, 1.0, rng.expovariate(1), 10 ** rng.uniform(-9, 9)])) for k in ("a", "b", None) for _ in range({"a": 3000, "b": 3, None: 400}[k])]
    places = {"low": percentiles.floor_place(0.05), "mid": percentiles.upper_place(), "high": percentiles.nearest_place(0.999)}
    got = {r["k"]: r for r in percentiles.ranked_values(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", places).collect()}
    for k in ("a", "b", None):
        s = sorted(v for x, v in rows if x == k and v is not None)
        n = len(s)
        if n:
            assert (got[k]["count"], got[k]["low"], got[k]["mid"], got[k]["high"]) == (n, s[max(0, int(n * 0.05 - 1))], s[n // 2], s[-(-n * 999 // 1000) - 1])


def naive_quota(weights, most, cap):
    raw = [most * w / sum(max(0.05, x) for x in weights) for w in weights]
    out = [min(cap, int(r)) for r in raw]
    for order in (sorted(range(len(raw)), key=lambda i: -(raw[i] - int(raw[i]))), sorted(range(len(raw)), key=lambda i: -weights[i])):
        for i in order:
            if sum(out) < most and out[i] < cap:
                out[i] += 1
    return out


@pytest.mark.parametrize(("most", "cap"), [(137, 20), (100, 100), (7, 3), (500, 12)])
def test_quotas(spark, most, cap):
    got = quota.category_quotas(spark.createDataFrame([(i, float(w)) for i, w in enumerate(K.CATEGORY_WEIGHTS)], "category int, weight double"), most, cap)
    assert [r["quota"] for r in got.orderBy("category").collect()] == naive_quota(K.CATEGORY_WEIGHTS, most, cap)


@pytest.mark.parametrize(("w", "s", "g"), [(0, 0, 0), (10, 0, 0), (5, 5, 90), (100, 10, 50), (3, 50, 2)])
def test_mix_counts_hold_the_ratios(w, s, g):
    take = quota.take_counts(w, s, g, 0.7, 0.2, 0.25)
    assert take["web_corpus"] <= w and take["session"] <= s and take["glossary"] <= g
    total = sum(take.values())
    if w and s and total:
        assert take["glossary"] <= 0.25 * total + 1


def test_kth_smallest(spark):
    rows = spark.range(500).withColumn("u", F.md5(F.col("id").cast("string").cast("binary")))
    s = sorted(r["u"] for r in rows.collect())
    assert [quota.kth_smallest(rows, "u", k) for k in (1, 250, 500)] == [s[0], s[249], s[499]]


def test_split_of_one_row(spark):
    assert [r["split"] for r in quota.train_valid_split(spark.range(1).toDF("id"), "id", 0.3).collect()] == ["train"]


def test_session_pairs_without_rejected_and_equal_answers(spark):
    rev = spark.createDataFrame([("k", "Good", "chosen", 0), ("k", " good ", "rejected", 1), ("k", "bad", "rejected", 2), ("m", "one", "chosen", 0), ("n", "x", "chosen", 0)], "key string, answer string, label string, pos long").withColumn("tags", F.array().cast("array<string>"))
    made = spark.createDataFrame([("m", "ONE", 0), ("m", "two", 1)], "key string, completion string, pos long")
    got = {(r["key"], r["rejected"], r["source"]) for r in dpo.session_pairs(rev, made).collect()}
    assert got == {("k", "bad", "reviewed_session_pair"), ("m", "two", "reviewed_plus_sampled")}


def test_session_pairs_of_both_directions(spark):
    """Against the rule read literally, over random reviews."""
    rng = random.Random(2)
    rev = [(rng.choice("kmno"), rng.choice(["Yes", "yes ", "no", "maybe", " ", "so"]), rng.choice(["chosen", "rejected", "skipped"]), [["t"], []][rng.random() < 0.5], i) for i in range(40)]
    made = [(rng.choice("kmnop"), rng.choice(["Yes", "NO", "", "else"]), i) for i in range(12)]
    norm = lambda x: x.strip().lower()
    want, seen = [], set()
    for key in sorted({r[0] for r in rev}):
        good = [r for r in rev if r[0] == key and r[2] == "chosen" and r[1].strip()]
        bad = [r for r in rev if r[0] == key and r[2] == "rejected" and r[1].strip()]
        samples = [m for m in made if m[0] == key and m[1].strip()]
        for own, other, source, direction in ((good, bad, "reviewed_plus_sampled", 0), (bad, good, "sampled_repair_pair", 1)):
            for r in own:
                found = next(((x[1], "reviewed_session_pair", x[3]) for x in other if norm(x[1]) != norm(r[1])), None) or next(((x[1], source, []) for x in samples if norm(x[1]) != norm(r[1])), None)
                if found:
                    pair = (r[1], found[0]) if direction == 0 else (found[0], r[1])
                    k = (key, norm(pair[0]), norm(pair[1]))
                    if k not in seen:
                        seen.add(k)
                        want.append((*k, found[1], bool(found[2] if direction == 0 else r[3])))
    got = dpo.session_pairs(spark.createDataFrame(rev, "key string, answer string, label string, tags array<string>, pos long"), spark.createDataFrame(made, "key string, completion string, pos long")).collect()
    assert sorted((r["key"], norm(r["chosen"]), norm(r["rejected"]), r["source"], r["reason_tags"] == ["t"]) for r in got) == sorted(want)


@pytest.mark.parametrize("most", [chunks.BROADCAST_TOKENS, 0])
def test_retrieval_against_all_chunks(spark, sf_dir, monkeypatch, most):
    """By one pass over the chunks, and by tokens that a result must share."""
    from dialogmill.plans.base import table

    monkeypatch.setattr(chunks, "BROADCAST_TOKENS", most)
    chunked = chunks.chunks(dq._sources(spark, sf_dir)).cache()
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 200).alias("query"), F.lit("mixed").alias("intent"))
    got = {(r["query_id"], r["rank"]): (r["source_id"], r["chunk_no"]) for r in chunks.retrieve(chunked, asked, 5, dq.AS_OF).collect()}
    rows = chunked.withColumn("w", chunks.base_weight(F.col("source_type"), F.lit("mixed"))).collect()
    for q in asked.withColumn("t", chunks.query_tokens(F.col("query"))).limit(5).collect():
        def score(r, own=set(q["t"])):
            fresh = 1.0 - max(0.0, min(1.0, (dq.AS_OF - r["updated_ms"]) / (86_400_000.0 * 90)))
            return round(r["w"] + len(own & set(r["tokens"])) / len(own) * 1.2 + fresh * 0.08, 9)
        best = sorted(rows, key=lambda r: (-score(r), r["source_id"], r["chunk_no"]))[:5]
        assert [score(r) for r in best] == [score(next(r for r in rows if (r["source_id"], r["chunk_no"]) == got[q["query_id"], k])) for k in range(1, 6)]


def test_interval_join_at_edges(spark):
    left = spark.createDataFrame([(1, 1, 0), (2, 1, 999)], "event_id long, user_id long, ms long")
    right = spark.createDataFrame([(3, 1, 650), (4, 1, 651), (5, 1, 0), (6, 2, 10), (7, 1, 1649)], "event_id long, user_id long, ms long")
    assert {(r["event_id"], r["right_id"]) for r in turns.within(left, right, "user_id", "ms", 650).collect()} == {(1, 3), (1, 5), (2, 7)}


def test_replace_sources(spark):
    rows = spark.createDataFrame([("note", "A", 1, "x"), ("note", "a", 2, "y")], "type string, name string, importedAtMs long, content string")
    assert [r["content"] for r in replace_sources(rows).collect()] == ["y"]


def test_greedy_resolution_decides_long_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(104)], "a long, b long")
    assert {r[0] for r in near_dup.resolve_greedy(pairs).collect()} == set(range(1, 105, 2))


def test_dpo_answers_are_whole(spark, tmp_path):
    docs = [(0, "en", "a" * 400 + "good"), (40, "en", "a" * 400 + "bad"), (80, "en", "x" * 500), (1, "en", "y" * 250), (41, "en", "z" * 250)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (40, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    md5 = {hashlib.md5(t.encode()).hexdigest(): i for i, _, t in docs}
    found = lambda f: {(r["pos"], md5[r["chosen_md5"]], md5[r["rejected_md5"]]) for r in f(spark, str(tmp_path)).collect()}
    assert found(dq.dpo_legacy) == {(0, 0, 40)} and found(dq.dpo_session) == {(0, 0, 40), (1, 1, 41)}


def test_retrieval_uses_whole_passages(spark, tmp_path):
    text = " ".join(f"early{i}" for i in range(40))
    spark.createDataFrame([(0, 0, text + " quokka wombat numbat")], "item_id long, x long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["other words fill this chunk of text until it is long enough to be kept " * 2] * 90
    texts[81] = "quokka wombat numbat are the words at the end of this passage and nothing else is shared with it at all"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["source_id"]: r["score"] for r in dq.retrieve_topk(spark, str(tmp_path)).collect()}
    base = {r["source_id"]: r["score"] for r in got_without(spark, tmp_path)}
    assert got[81] > base.get(81, 0)


def got_without(spark, tmp_path):
    asked = spark.createDataFrame([(0, "early0", next(iter(K.INTENT_MULTIPLIER)))], "query_id long, query string, intent string")
    return chunks.retrieve(chunks.chunks(dq._sources(spark, str(tmp_path))), asked, limit=90, as_of_ms=dq.AS_OF).collect()


@pytest.mark.parametrize(("max_docs", "max_per_category", "max_per_domain", "window"), [(900, 90, 20, 240), (14, 6, 3, 2)])
def test_web_rules_that_look_at_other_pages(spark, sf_dir, max_docs, max_per_category, max_per_domain, window):
    """Each reason that speaks of other pages holds, and none holds for a kept page, in the order of arrival."""
    from dialogmill.functions import text as t
    from dialogmill.plans import web_queries as wq

    specs = spark.createDataFrame(list(enumerate(wq.CATEGORIES.values())), "category int, weight double")
    quotas = {list(wq.CATEGORIES)[r["category"]]: r["quota"] for r in wq.category_quotas(specs, max_docs, max_per_category).collect()}
    rows = wq.rejected(spark, sf_dir, max_docs=max_docs, max_per_category=max_per_category, max_per_domain=max_per_domain, window=window).withColumn("s", t.token_set(F.col("body"))).collect()
    places = {c: i for i, c in enumerate(wq.CATEGORIES)}
    taken, seen = [], set()
    for r in sorted(rows, key=lambda r: (places.get(r["category"], 99), r["page_id"])):
        s = frozenset(r["s"])
        full = len(taken) >= max_docs, sum(x["category"] == r["category"] for x in taken) >= quotas.get(r["category"], max_per_category)
        holds = {
            "max_docs": full[0], "category_quota": full[1], "duplicate_url": any(x["canonical"] == r["canonical"] for x in taken), "per_domain_cap": sum(x["host"] == r["host"] for x in taken) >= max_per_domain,
            "near_duplicate": any(s and len(s & set(x["s"])) >= 0.84 * len(s | set(x["s"])) for x in taken[-window:]), "fingerprint_duplicate": any(s == set(x["s"]) for x in taken),
        }
        seen.add(r["reason"])
        if r["reason"] is None:
            assert not any(holds.values()), (r["page_id"], holds)
            taken.append(r)
        elif r["reason"] in holds:
            assert next(k for k, v in holds.items() if v and (k != "fingerprint_duplicate" or not holds["near_duplicate"])) == r["reason"]
        else:
            assert not any(full)
    assert taken and (max_docs == 900 or {"category_quota", "per_domain_cap"} & seen)


def test_tier1_only(spark, sf_dir):
    from dialogmill.plans import web_queries as wq

    only = {r["reason"] for r in wq.rejected(spark, sf_dir, tier1_only=True).collect()}
    assert "tier1_only_filtered" in only and "allow_domain_filtered" not in only


def test_equal_pairs_of_a_pool_are_said_once(spark, tmp_path):
    from pathlib import Path

    from dialogmill.operators import records

    said = "I built the cache and measured it. " * 8
    rows = [(f"g|{i}", 500 - i, "Why  a cache?", said, None, True, "glossary", "glossary") for i in range(400)]  # equal as they come
    rows += [("g|s", 7, "Why a cache?", said.replace(". ", ".  "), 0.9, True, None, "other")]  # equal as it is said
    rows += [("g|no", 1, "Why a cache?", said, 0.5, False, None, "x"), ("g|q", 2, " ", said, 0.5, None, None, "x"), ("g|null", 3, "Why not?", None, None, None, "", "y")]
    df = spark.createDataFrame(rows, "id string, ord long, question string, answer string, hint double, fit boolean, category string, source string")
    df = df.selectExpr("*", "'glossary' AS pool", "'glossary' AS bucket", "'glossary_filter' AS fault")
    before = set(Path(shared_folder(spark).removeprefix("file://")).glob("build-spoken-*"))
    left, dropped = records.pooled(df)
    (written,) = set(Path(shared_folder(spark).removeprefix("file://")).glob("build-spoken-*")) - before
    # 400 pairs are one, and so are the two that aren't fit
    assert spark.read.parquet(f"file://{written}").count() == 4
    assert [(r["id"], r["source"], r["quality"] >= 0.9) for r in left.collect()] == [("g|s", "other", True)]
    assert {r["drop"]: r["n"] for r in dropped.collect()} == {"duplicate": 400, "glossary_filter": 3}
    empty_left, empty = records.pooled(df.where("NOT fit"))
    assert empty_left.count() == 0 and [tuple(r) for r in empty.collect()] == [("glossary_filter", 1)]


def test_counters_of_a_build_read_each_table_once(spark, tmp_path):
    from dialogmill.operators import records

    rows = [("1", "web_corpus", "web", "x"), ("2", "session", "web", "x"), ("3", "session", "made", None)]
    spark.createDataFrame(rows, "id string, bucket string, source string, category string").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    out = records.build_counters(rows, spark.createDataFrame([("duplicate", 4)], "drop string, n long"), rows.where("id <> '1'"))
    want = {("dropped", "duplicate", 4), ("raw_bucket", "web_corpus", 1), ("raw_bucket", "session", 2), ("raw_source", "web", 2), ("raw_source", "made", 1), ("raw_category", "x", 2), ("raw_category", None, 1)}
    want |= {("final_bucket", "session", 2), ("final_source", "web", 1), ("final_source", "made", 1), ("final_category", "x", 1), ("final_category", None, 1)}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
