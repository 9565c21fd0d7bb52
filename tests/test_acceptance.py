"""Acceptance in order against a sequential loop."""

import random

import pytest

from dialogmill.operators import acceptance


def sequential(pages, quotas, threshold, window, max_per_domain, max_docs, other=1 << 60):
    out, seen, urls, prints, hosts, categories = [], [], set(), set(), {}, {}
    for pos, url, host, category, tokens in sorted(pages):
        tokens = frozenset(tokens)
        if len(out) >= max_docs or categories.get(category, 0) >= quotas.get(category, other) or url in urls or hosts.get(host, 0) >= max_per_domain or tokens in prints:
            continue
        if any(a and tokens and len(a & tokens) / len(a | tokens) >= threshold for a in seen[-window:]):
            continue
        out.append(pos)
        seen.append(tokens)
        urls.add(url)
        prints.add(tokens)
        hosts[host], categories[category] = hosts.get(host, 0) + 1, categories.get(category, 0) + 1
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    base = [[f"t{rng.randrange(60)}" for _ in range(12)] for _ in range(12)]
    out = []
    for i in range(n):
        tokens = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            tokens[rng.randrange(len(tokens))] = f"t{rng.randrange(60)}"
        out.append((i * 3, f"u{rng.randrange(n)}", f"h{min(rng.randrange(9), rng.randrange(9))}", "abc"[i * 3 // n], sorted(set(tokens)) if i % 40 else []))
    return out


@pytest.mark.parametrize(("seed", "window", "max_per_domain", "max_docs", "quota", "tail"), [(1, 1, 6, 900, 900, 4096), (2, 3, 100, 40, 12, 4096), (3, 240, 8, 900, 30, 4096), (4, 5, 20, 60, 900, 30), (5, 240, 6, 900, 10, 0)])
def test_rounds_equal_the_loop(spark, seed, window, max_per_domain, max_docs, quota, tail):
    pages, quotas = made(seed, 120 if tail else 40), {"a": 20, "b": quota}
    rows = spark.createDataFrame(pages, "pos long, url string, host string, category string, tokens array<string>")
    table = spark.createDataFrame(list(quotas.items()), "category string, quota long")
    got = sorted(acceptance.accept(rows, table, 0.6, window, max_per_domain, max_docs, tail=tail).collect())
    want = sequential(pages, quotas, 0.6, window, max_per_domain, max_docs)
    assert [tuple(r) for r in got] == [(pos, n) for n, pos in enumerate(want)] and len(want) > 10


def test_a_chain_of_similar_pages(spark):
    """Each is similar to its neighbours only, so every second one stays."""
    pages = [(i, f"u{i}", "h", "a", [f"t{j}" for j in range(i, i + 6)]) for i in range(30)]
    rows = spark.createDataFrame(pages, "pos long, url string, host string, category string, tokens array<string>")
    none = spark.createDataFrame([], "category string, quota long")
    for tail in (0, 4096):
        got = {r["pos"] for r in acceptance.accept(rows.where("pos < 8") if not tail else rows, none, 0.7, 240, 100, tail=tail).collect()}
        assert got == set(range(0, 8 if not tail else 30, 2))
    assert acceptance.accept(rows.limit(0), none).count() == 0


def test_caps_that_bind_end_the_rounds(spark, monkeypatch):
    """Categories take turns, of which two fill from their first pages, one never fills and one takes none."""
    pages = [(pos, url, host, "abbbcd"[pos % 6], tokens) for pos, url, host, _, tokens in ((p[0] // 3, *p[1:]) for p in made(6, 240))]
    rows = spark.createDataFrame(pages, "pos long, url string, host string, category string, tokens array<string>")
    quotas = {"a": 3, "b": 4, "c": 0}
    table = spark.createDataFrame(list(quotas.items()), "category string, quota long")
    rounds, counted = [], acceptance._counted
    monkeypatch.setattr(acceptance, "_counted", lambda *a: rounds.append(1) or counted(*a))
    for tail, most in ((100, 2), (24, 12)):
        rounds.clear()
        got = sorted(acceptance.accept(rows, table, 0.6, 5, 100, 900, tail=tail).collect())
        assert [tuple(r) for r in got] == [(pos, n) for n, pos in enumerate(sequential(pages, quotas, 0.6, 5, 100, 900))] and len(got) > 10
        assert len(rounds) <= most


def test_a_crawl_by_levels(spark):
    """Categories don't share what they have seen; cycles end; a page's later links don't count."""
    from dialogmill.operators.frontier import frontier

    links = [("a", 1, "b"), ("a", 2, "c"), ("a", 3, "far"), ("b", 1, "a"), ("b", 2, "d"), ("c", 1, "d"), ("d", 1, "e"), ("z", 1, "a"), ("b", 1, "d")]
    rows = spark.createDataFrame(links, "src string, rank int, link string")
    seeds = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "z"), (None, "b")], "category string, url string")
    got = {tuple(r) for r in frontier(seeds, rows, depth=2, per_page=2).collect()}
    assert got == {("x", "a", 0, None), ("x", "b", 1, "a"), ("x", "c", 1, "a"), ("x", "d", 2, "b"), ("y", "z", 0, None), ("y", "a", 1, "z"), ("y", "b", 2, "a"), ("y", "c", 2, "a"), (None, "b", 0, None), (None, "a", 1, "b"), (None, "d", 1, "b"), (None, "c", 2, "a"), (None, "e", 2, "d")}
    assert frontier(seeds, rows, depth=9, per_page=1).where("category = 'x'").count() == 4
    assert frontier(seeds.limit(0), rows, depth=2).count() == 0
