"""URL filter: host rules first, then a weighted vocabulary found by one Aho-Corasick pass.

A url's terms are matched in its lower-cased characters with boundaries: the characters beside a
hit must not be ASCII letters or digits. One strict term, or ``min_soft`` distinct soft terms, blocks.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
by the vocabulary on whatever text it has (null: allow). Urls are judged whole, in time proportional to their length. Of rules of
equal length that fit, a blocking one wins. Rows, repeated ones too, are judged one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from dialogmill.llm.common import prepare_python, table

#: Terms that block alone.
STRICT = (
    "adult bdsm blackjack camgirl camgirls camsex casino cialis cuckold deepfakeporn dildo escort escorts fetish gangbang hardcoreporn hentai hookup jackpot keygen "
    "keygens kinky levitra livesex malware megaporn milf nude nudes onlyfans orgasm payday phishing pills porn porno pornhub pornstar roulette sex "
    "sexcam sexchat sexshop sextoys sexy slots spam spyware sportsbet steroids stripper strippers tramadol upskirt valium viagra voyeur warez webcamsex xanax xnxx xvideos xxx"
).split()
#: Terms of which several distinct ones block.
SOFT = (
    "ad ads affiliate affiliates banner bet bets betting bonus bonuses buy cashback cheap cheapest click clickbait clone coupon coupons crack cracked credit crypto "
    "deal deals discount discounts download earn earnings farm fast forex free freebie freebies gamble gift giveaway hack hacks income instant limited loan loans lottery "
    "lowest luxury miracle mlm money offer offers outlet poker popup prize prizes promo promos refinance replica rich sale sales serial sponsor sponsored stream sweepstakes torrent "
    "torrents track tracker tracking traffic trial unlimited unlock win winner winners"
).split()
#: A vocabulary table may have so many terms; it goes to every task.
MOST_TERMS = 200_000
#: (verdict, host, path)
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class UrlPolicy:
    strict: list[str] = field(default_factory=lambda: list(STRICT))
    soft: list[str] = field(default_factory=lambda: list(SOFT))
    min_soft: int = 2
    host_rules: list[tuple[str, str, str]] = field(default_factory=lambda: list(HOST_RULES))


def load_vocabulary(terms: DataFrame, **others) -> UrlPolicy:
    """A policy with the terms of a table (term, kind: ``strict`` or ``soft``), of whatever source; others as UrlPolicy has them.

    Terms are lower-cased and stripped; empty and null ones are left out. A table with over MOST_TERMS terms or other kinds is an error.
    """
    rows = terms.select("term", "kind").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    if odd := sorted({str(r["kind"]) for r in rows} - {"strict", "soft"}):
        raise ValueError(f"kinds of terms are strict and soft, not {', '.join(odd)}")
    of = lambda kind: sorted({t for r in rows if r["kind"] == kind and (t := (r["term"] or "").strip().translate(_UPPER))})
    return UrlPolicy(strict=of("strict"), soft=of("soft"), **others)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_UPPER), rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:end]


class UrlJudge:
    """Built once for each task: the automaton and the rules by host."""

    def __init__(self, policy: UrlPolicy):
        import ahocorasick

        self.policy = policy
        self.terms = ahocorasick.Automaton()
        for kind, terms in ((1, policy.soft), (2, policy.strict)):  # a term in both lists is strict
            for term in terms:
                self.terms.add_word(term, (kind, term))
        if len(self.terms):
            self.terms.make_automaton()
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in policy.host_rules:
            self.by_host.setdefault(host, []).append((verdict, path, host + path))

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits the host or a parent domain and begins the path; block wins a tie."""
        best, name = None, host
        while True:
            for verdict, start, rule in self.by_host.get(name, ()):
                if path.startswith(start) and (best is None or (len(rule), verdict == "block", rule) > (len(best[1]), best[0] == "block", best[1])):
                    best = (verdict, rule)
            _, dot, name = name.partition(".")
            if not dot:
                return best

    def counts(self, url: str | None) -> tuple[int, int]:
        """(hits of strict terms, distinct soft terms)."""
        if not url or not len(self.terms):
            return 0, 0
        low, strict, soft = url.translate(_UPPER), 0, set()
        for end, (kind, term) in self.terms.iter(low):
            start = end - len(term)
            if (start < 0 or low[start] not in _WORD) and (end + 1 == len(low) or low[end + 1] not in _WORD):
                if kind == 2:
                    strict += 1
                else:
                    soft.add(term)
        return strict, len(soft)

    def verdict(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        fits = self.rule(host, path)
        strict, soft = self.counts(url)
        own = "block" if strict or soft >= self.policy.min_soft else "allow"
        return host, path, fits[1] if fits else None, fits[0] if fits else own, strict, soft


def url_filter(pages: DataFrame, policy: UrlPolicy | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_terms for every row of ``pages`` (page_id, url)."""
    prepare_python(pages.sparkSession)
    policy = policy or UrlPolicy()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = UrlJudge(policy)
        for batch in batches:
            rows = [one.verdict(url) for url in batch.column(1).to_pylist()]
            host, path, rule, verdict, strict, soft = map(list, zip(*rows, strict=True)) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(strict, pa.int64()), pa.array(soft, pa.int64())], names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_terms long")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op4_sql(policy: UrlPolicy | None = None) -> str:
    """The same verdicts by regular expressions, one for each term."""
    policy = policy or UrlPolicy()
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # a hit may share its boundary with the next, so strict hits count the starts of matches
    hit = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"
    count = lambda term: f"(len(regexp_split_to_array(regexp_replace('/' || low || '/', '[^a-z0-9]', '//', 'g'), '[/]{term}[/]')) - 1)"
    strict = " + ".join(count(t) for t in policy.strict)
    soft = " + ".join(f"{hit(t)}::INT" for t in policy.soft)
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in policy.host_rules)
    return f"""
WITH a AS (SELECT page_id, {lower} AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT * FROM (VALUES {rules}) AS v(verdict, h, p)),
c AS (SELECT b.*, ({strict})::BIGINT AS strict_hits, ({soft})::BIGINT AS soft_terms FROM b),
m AS (SELECT c.*, (SELECT max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) FROM r WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS best FROM c)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN strict_hits > 0 OR soft_terms >= {policy.min_soft} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_terms FROM m
"""
