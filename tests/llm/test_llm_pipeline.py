"""The pipeline's stages, each against a plain version on the rows it was given."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import naive_components, naive_fingerprint, naive_lines

import corpus_pipeline
from dialogmill.llm import common, shingles
from dialogmill.llm.bpe import TOKENIZER, tokenizer_path


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = common.table(spark, sf_dir, "documents")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "test-" + name.replace(" ", "-"))
        seen.append(docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    start, good, lines, near, mixed, encoded = seen
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"] for r in good}
    assert np.mean([(r["doc_id"] in kept) == bool(labels[r["doc_id"]]) for r in start if r["doc_id"] in labels]) >= 0.95
    want = naive_lines([(r["doc_id"], r["text"]) for r in good], 1)
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, t in want.items() if t.split()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    prints = [(r["doc_id"], naive_fingerprint(r["text"])) for r in lines]
    assert {r["doc_id"] for r in near} == set(naive_components(prints).values())
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in near} and len(mixed) >= len(near)
    library, texts = Tokenizer.from_file(tokenizer_path(TOKENIZER)), {r["doc_id"]: r["text"] for r in near}
    assert len(encoded) == len(mixed)
    for r in encoded:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def naive_kept(rows):
    """The smallest id of each component by fingerprints and five-word shingles, by all pairs; rows: (doc_id, text) with distinct ids."""
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(5)])) or {t} for i, t in rows}
    prints = {i: naive_fingerprint(t) for i, t in rows}
    left, kept = sorted(sets), []
    while left:
        front, group = [left[0]], {left[0]}
        while front:
            a = front.pop()
            near = [b for b in left if b not in group and ((prints[a] ^ prints[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
            group.update(near)
            front += near
        kept.append(min(group))
        left = [x for x in left if x not in group]
    return set(kept)


def test_run_against_plain_versions(spark, sf_dir):
    """run() itself: its documents, times used, and the tokens of their texts as the library has them."""
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = common.table(spark, sf_dir, "documents")
    good = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality_classifier(spark, docs, sf_dir).collect()]
    lines = {i: t for i, t in naive_lines(good, 1).items() if t.split()}
    kept = naive_kept(list(lines.items()))
    assert {r["doc_id"] for r in got} == kept
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, used = {}, {}
    for i in kept:
        sizes[source[i]] = sizes.get(source[i], 0) + len(lines[i].split())
    for r in got:
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + 1
    largest = max(sizes, key=sizes.get)
    assert all(1 <= n <= 2 for n in used.values()) and {used[i] for i in kept if source[i] == largest} == {1}
    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    for r in got:
        ids = library.encode(lines[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_one_id_with_several_texts(spark):
    """A copy goes even if its id is the smallest one's own; rows without an id go if another copy has one."""
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [(1, copy, "s"), (1, copy.replace("w7 ", "v7 "), "s"), (1, "some other text of one id", "s"), (2, copy, "s"), (None, copy, "s"), (None, "a text without an id", "s"), (1, copy, "s")]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), None).collect()
    near = [r for r in kept if r["text"].startswith("w0 ")]
    assert {r["doc_id"] for r in near} == {1} and len({r["text"] for r in near}) == 1
    assert {(r["doc_id"], r["text"]) for r in kept if not r["text"].startswith("w0 ")} == {(1, "some other text of one id"), (None, "a text without an id")}


def test_edges_of_stages(spark):
    from test_llm_operators import EDGES

    rows = spark.createDataFrame([(i, t, "en", s, len(t) if t else None, "x") for i, t, s in EDGES], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for name in ("keeper", "n_lines", "quality_score", "kept", "block", "t", "__keep", "__t", "__rest", "_", "a`b", "c.d"):  # names of columns that stages add, and odd ones
        rows = rows.withColumn(name, F.col("source"))
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, None)
            if name != "bpe":
                assert out.columns == docs.columns
            got = [r["doc_id"] for r in out.collect()]
            assert set(got) <= {i for i, _, _ in EDGES}
            if name in ("mixing", "bpe") and docs is rows:
                assert set(got) == {i for i, _, _ in EDGES}
            if name == "simhash near-dedup" and docs is rows:
                assert None in got and 5 not in got and 0 in got


@pytest.mark.parametrize("sizes", [{}, {"small": 0, "large": 8, "block": 7}, {"small": 3, "large": 2}])
def test_near_copies_of_five_word_shingles(spark, sizes):
    """Against all pairs: copies at 0.8 or more go, whatever bits of their fingerprints differ."""
    import random

    rng = random.Random(7)
    rows, at = [], 0
    for words, changes, copies in [(60, 1, 8), (120, 1, 40), (200, 4, 12), (500, 10, 6), (100, 12, 6), (4, 0, 3), (90, 0, 1), (590, 10, 8), (4700, 60, 4), (4700, 2500, 3)]:
        base = [f"w{rng.randrange(50000)}" for _ in range(words)]
        for k in range(copies):
            text = base.copy()
            for i in rng.sample(range(words), changes if k else 0):
                text[i] = f"x{rng.randrange(10**6)}"
            rows.append((at, " ".join(text), "en", "s", 1))
            at += 1
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) or {t} for i, t, *_ in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = {i: naive_fingerprint(t) for i, t, *_ in rows}
    near = [(a, b) for a in sets for b in sets if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert len(set(pairs) - set(near)) > 20
    for a, b in pairs + near:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, None)
    assert {r["doc_id"] for r in kept.collect()} == {top(i) for i in sets}
    found = shingles.similar_links(common.materialize(shingles.shingle_sets(docs), "test-sets"), docs, **sizes).collect()
    ids = {}
    for i, p in prints.items():
        ids.setdefault(p, i)
    linked = [(ids[r["a"] % 2**64], ids[r["b"] % 2**64]) for r in found]
    groups = naive_groups(ids.values(), linked)
    assert groups == naive_groups(ids.values(), [(a, b) for a, b in pairs if a in ids.values() and b in ids.values()])


def naive_groups(nodes, links):
    group = {i: {i} for i in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {frozenset(g) for g in group.values()}
