"""Queries over pages: cleaning, links, URL policy, rejection reasons, quotas and caps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialogmill.functions import constants as K
from dialogmill.functions import scoring as sc
from dialogmill.functions import text as t
from dialogmill.functions import web
from dialogmill.operators import acceptance, scan
from dialogmill.operators.frontier import frontier
from dialogmill.operators.quota import category_quotas, even_quotas
from dialogmill.operators.state import kept, small_enough
from dialogmill.plans import sql as q
from dialogmill.plans.base import SQL, pages, query
from dialogmill.plans.text_queries import _noise_sql, web_quality_sql

C = F.col
BLOCKED = ["spam-farm.example.org", "spam-farm.example.com", "casino-win.example.com", "ads-track.example.org"]
TIER1, ALLOWED = ["example.com"], ["example.com", "example.org"]
EXCLUDED = [r"\?utm_", r"/(login|signup)", r"/9\d\d$"]
#: So many kept pages are sent to all tasks.
BROADCAST = 100_000
#: Pages of the test tables are short, so the least length and quality are lower than a real corpus asks for.
MIN_CHARS, MIN_QUALITY, MAX_PER_DOMAIN, NEAR, WINDOW = 400, 0.2, 20, 0.84, 240


@query(f"WITH h AS (SELECT page_id, {q.html_text('html')} AS body FROM pages) SELECT page_id, md5(body) AS body_md5, length(body)::INT AS n_chars, 'simple' AS extract_method FROM h")
def html_text(spark, sf_dir):
    rows = pages(spark, sf_dir, "page_id", "html").select("page_id", web.html_text(C("html")).alias("body"))
    return rows.select("page_id", F.md5(C("body").cast("binary")).alias("body_md5"), F.length("body").alias("n_chars"), F.lit("simple").alias("extract_method"))


_TITLE = f"substr({q.html_text('''regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)''')}, 1, 180)"
_TITLE = f"(CASE WHEN {_TITLE} <> '' THEN {_TITLE} WHEN {q.authority('url')} <> '' THEN {q.authority('url')} ELSE 'web' END)"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def html_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", web.title(C("html"), C("url")).alias("title"))


_FOLDER = f"regexp_extract(CASE WHEN {q.path('url')} = '' THEN '/' ELSE {q.path('url')} END, '^(.*/)', 1)"
_ROOT = f"{q.scheme('url')} || '://' || {q.host('url')}"


@query(f"""
WITH h AS (SELECT page_id, url, list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?i)href=["'']([^"'']+)["'']', 1), lambda x: {q.strip(q.unescape('x'))}), lambda x: x <> '' AND NOT starts_with(x, '#')) AS hrefs FROM pages),
e AS (SELECT page_id, url, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS pos FROM h),
a AS (SELECT page_id, pos, CASE WHEN starts_with(href, '//') THEN {q.scheme('url')} || ':' || href WHEN starts_with(href, 'http://') OR starts_with(href, 'https://') THEN href WHEN starts_with(href, '/') THEN {_ROOT} || href ELSE {_ROOT} || {_FOLDER} || href END AS target FROM e),
c AS (SELECT page_id, pos, {q.canonical('target')} AS link FROM a),
f AS (SELECT page_id, link, min(pos) AS pos FROM c WHERE link <> '' GROUP BY ALL)
SELECT page_id, link, (row_number() OVER (PARTITION BY page_id ORDER BY pos))::INT AS rank FROM f QUALIFY rank <= 18
""")
def html_links(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url", F.posexplode(web.links(C("html"))).alias("pos", "href"))
    rows = rows.select("page_id", "pos", web.canonical(web.absolute(C("href"), C("url"))).alias("link")).where("link <> ''")
    rows = rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("rank <= 18").drop("pos")


@query(f"SELECT page_id, {q.host('url')} AS host, {q.canonical('url')} AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return pages(spark, sf_dir, "page_id", "url").select("page_id", web.host(C("url")).alias("host"), web.canonical(C("url")).alias("canonical"))


_matches = lambda h, ds: "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in ds) + ")"
_excluded = lambda u: "regexp_matches(" + u + ", '(?i)" + "|".join(f"({p})" for p in EXCLUDED) + "')"


@query(f"SELECT page_id, {q.host('url')} AS host FROM pages WHERE NOT {_matches(q.host('url'), BLOCKED)} AND {_matches(q.host('url'), ALLOWED)} AND NOT {_excluded(q.canonical('url'))}")
def domain_policy(spark, sf_dir):
    """Anti join with the block list and semi join with the allow list, which are broadcast: they are lists of a configuration."""
    rows = pages(spark, sf_dir, "page_id", "url").select("page_id", web.host(C("url")).alias("host"), web.canonical(C("url")).alias("u"))
    # a host and its parent domains as keys, so that the suffix match is an equality
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), "."))
    rules = spark.createDataFrame([(d, "block") for d in BLOCKED] + [(d, "allow") for d in ALLOWED], "domain string, rule string")
    keyed = rows.select("page_id", F.explode(parents).alias("domain")).join(F.broadcast(rules), "domain")
    verdict = keyed.groupBy("page_id").agg(F.bool_or(C("rule") == "block").alias("blocked"), F.bool_or(C("rule") == "allow").alias("allowed"))
    kept = rows.where(~web.excluded(C("u"), EXCLUDED)).join(verdict.where("allowed AND NOT blocked"), "page_id", "left_semi")
    return kept.select("page_id", "host")


REDIRECTS = ["//duckduckgo.com/l/?x=1", "https://a.example/x", "/l/?kh=-1&amp;uddg=https%3A%2F%2Fb.example%2Fp%3Fq%3D1", "/plain", "/l/?uddg="]
_RED = "r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q.quoted(x)})" for i, x in enumerate(REDIRECTS)) + ") AS v(id, href))"


@query(f"WITH {_RED}, u AS (SELECT id, {q.unescape('href')} AS h FROM r) SELECT id, CASE WHEN starts_with(h, '//') THEN 'https:' || h WHEN regexp_matches(h, '^https?://') THEN h WHEN regexp_extract(h, '[?&]uddg=([^&#]*)', 1) <> '' THEN url_decode(regexp_extract(h, '[?&]uddg=([^&#]*)', 1)) ELSE h END AS target FROM u")
def redirect_decode(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(REDIRECTS)), "id int, href string").select("id", web.redirect_target(C("href")).alias("target"))


#: Categories by the first part of a url's path, in their order, with weights; others have the cap itself.
CATEGORIES = dict(zip(("en", "fr", "de", "es"), map(float, K.CATEGORY_WEIGHTS)))
MAX_DOCS, MAX_PER_CATEGORY = 900, 90
_CATEGORY = "^/([a-z]+)/"


def few(rows):
    """The rows, marked to be broadcast if they are few, as caps of a configuration make kept pages."""
    return F.broadcast(rows) if small_enough(rows, BROADCAST) else rows


def judged(spark, sf_dir, tier1_only=False, max_docs=MAX_DOCS, max_per_category=MAX_PER_CATEGORY, max_per_domain=MAX_PER_DOMAIN, window=WINDOW):
    """(pages: pos, page_id, canonical, host, category, title, body, quality and more; verdicts: pos, host, category, reason). The first rule that fails names the reason; null: kept.

    Pages come category by category, those of the configuration first, then by page_id, and are kept or not in this order: rules look at what
    was kept before. A page that comes when its category or the whole is full isn't looked at any further.
    """
    index = F.coalesce(F.array_position(F.array(*map(F.lit, CATEGORIES)), C("category")), F.lit(0))
    place = F.when(index == 0, len(CATEGORIES)).otherwise(index - 1).cast("long")
    rows = pages(spark, sf_dir).select("page_id", web.canonical(C("url")).alias("canonical"), web.host(C("url")).alias("host"), F.regexp_extract(web.path(C("url")), _CATEGORY, 1).alias("category"), web.title(C("html"), C("url")).alias("title"), web.html_text(C("html")).alias("body"), C("html").isNull().alias("missing"))
    of_url = (
        F.when(C("host") == "", "missing_host").when(web.matches_domain(C("host"), BLOCKED, empty=False), "blocked_domain")
        .when(F.lit(tier1_only) & ~web.matches_domain(C("host"), TIER1), "tier1_only_filtered").when(~web.matches_domain(C("host"), ALLOWED), "allow_domain_filtered").when(web.excluded(C("canonical"), EXCLUDED), "excluded_pattern")
    )
    of_text = F.when(C("missing"), "fetch_failed").when(F.length("body") < MIN_CHARS, "min_text_chars").when(sc.noise(C("body")), "noise")
    rows = rows.withColumn("quality", sc.web_quality(C("body"), C("title"))).withColumns({"of_url": of_url, "of_text": of_text, "tokens": t.token_set(C("body")), "pos": F.shiftleft(place, 40) + C("page_id")})
    rows = kept(rows.drop("missing").withColumn("print", t.fingerprint(C("tokens"))), "web-pages")
    specs = spark.createDataFrame([(i, w) for i, w in enumerate(CATEGORIES.values())], "category int, weight double")
    names = spark.createDataFrame(list(enumerate(CATEGORIES)), "category int, name string")
    quotas = category_quotas(specs, max_docs, max_per_category).join(names, "category").select(C("name").alias("category"), "quota")
    sound = (C("canonical") != "") & C("of_url").isNull() & C("of_text").isNull()
    fit = rows.where(sound & (C("quality") >= MIN_QUALITY)).select("pos", C("canonical").alias("url"), "host", "category", "tokens")
    found = kept(acceptance.accept(fit, quotas, NEAR, window, max_per_domain, max_docs, max_per_category), "web-kept")
    # what each page finds when it comes
    state = rows.select("pos", "canonical", "host", "category", "of_url", "of_text", "print").join(found.select("pos", C("n").alias("own")), "pos", "left")
    state = scan.dealt(state, [], ["pos"])
    one = C("own").isNotNull().cast("long")
    for name, parts in (("total", []), ("in_host", ["host"]), ("in_category", ["category"])):
        state = scan.sums_before(state, parts, ["pos"], {name: one})
    state = kept(state, "web-state")
    taken = few(state.where("own IS NOT NULL"))
    state = state.join(F.broadcast(quotas), "category", "left").withColumn("full", (C("total") >= max_docs) | (C("in_category") >= F.coalesce("quota", F.lit(max_per_category))))
    # similar texts matter only to pages that nothing before them in the order of the rules rejects
    asked = state.where(C("own").isNull() & ~C("full") & (C("in_host") < max_per_domain)).select("pos", C("total").alias("n"))
    similar = acceptance.similar_accepted(rows.where(sound).join(few(asked), "pos").select("pos", "n", "tokens"), rows.join(few(found), "pos").select("pos", "n", "tokens"), NEAR, window)
    state = state.join(taken.select("canonical", C("pos").alias("url_at")), "canonical", "left").join(taken.select("print", C("pos").alias("print_at")), "print", "left").join(similar.withColumn("similar", F.lit(True)), "pos", "left")
    reason = (
        F.when(C("own").isNotNull(), F.lit(None).cast("string")).when(C("total") >= max_docs, "max_docs").when(C("full"), "category_quota")
        .when(C("canonical") == "", "invalid_scheme_or_url").when(C("url_at") < C("pos"), "duplicate_url").when(C("of_url").isNotNull(), C("of_url")).when(C("in_host") >= max_per_domain, "per_domain_cap")
        .when(C("of_text").isNotNull(), C("of_text")).when(C("similar"), "near_duplicate").when(C("print_at") < C("pos"), "fingerprint_duplicate").otherwise("quality_threshold")
    )
    return rows, kept(state.select("pos", "host", "category", reason.alias("reason")), "web-judged")


def rejected(spark, sf_dir, **rules):
    """page_id, canonical, host, category, title, body, quality, reason of each page, as judged() has them."""
    rows, verdicts = judged(spark, sf_dir, **rules)
    return rows.join(verdicts.select("pos", "reason"), "pos").select("page_id", "canonical", "host", "category", "title", "body", "quality", "reason")


_QUOTAS = f"""
qc AS (SELECT unnest([{', '.join(str(w) for w in CATEGORIES.values())}]) AS w, unnest(range({len(CATEGORIES)})) AS i, unnest([{q.listed(CATEGORIES)}]) AS category),
qr AS (SELECT category, i, w, {MAX_DOCS} * (w / (SELECT sum(w) FROM qc)::DOUBLE) AS raw FROM qc), qb AS (SELECT *, least({MAX_PER_CATEGORY}, floor(raw)::BIGINT) AS base FROM qr),
qo AS (SELECT *, row_number() OVER (ORDER BY base >= {MAX_PER_CATEGORY}, raw - floor(raw) DESC, i) AS k, (SELECT {MAX_DOCS} - sum(base) FROM qb) AS left1 FROM qb), qp AS (SELECT *, base + (base < {MAX_PER_CATEGORY} AND k <= left1)::BIGINT AS one FROM qo),
qs AS (SELECT *, row_number() OVER (ORDER BY one >= {MAX_PER_CATEGORY}, w DESC, i) AS k2, (SELECT {MAX_DOCS} - sum(one) FROM qp) AS left2 FROM qp), quotas AS (SELECT category, one + (one < {MAX_PER_CATEGORY} AND k2 <= left2)::BIGINT AS quota FROM qs)"""
_NAMES = f"[{q.listed(CATEGORIES)}]"
_REJECTED = f"""
b AS MATERIALIZED (SELECT page_id, {q.canonical('url')} AS canonical, {q.host('url')} AS host, regexp_extract({q.path('url')}, '{_CATEGORY}', 1) AS category, {_TITLE} AS title, {q.html_text('html')} AS body, html IS NULL AS missing FROM pages),
l AS MATERIALIZED (SELECT *, {_noise_sql('body')[0]} AS lines, {web_quality_sql('body', 'title')} AS quality, {q.token_set('body')} AS toks, coalesce(nullif(list_position({_NAMES}, category), 0), {len(CATEGORIES) + 1}) AS place FROM b),
p0 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY place, page_id) AS pos, array_to_string(list_sort(toks), ' ') AS print,
  CASE WHEN host = '' THEN 'missing_host' WHEN {_matches('host', BLOCKED)} THEN 'blocked_domain' WHEN NOT {_matches('host', ALLOWED)} THEN 'allow_domain_filtered' WHEN {_excluded('canonical')} THEN 'excluded_pattern' END AS r1,
  CASE WHEN missing THEN 'fetch_failed' WHEN length(body) < {MIN_CHARS} THEN 'min_text_chars' WHEN {_noise_sql('body')[1]} THEN 'noise' END AS r2 FROM l),{_QUOTAS},
s AS MATERIALIZED (SELECT p0.*, coalesce(quota, {MAX_PER_CATEGORY}) AS most FROM p0 LEFT JOIN quotas USING (category)),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM s WHERE canonical <> '' AND r1 IS NULL AND r2 IS NULL AND quality >= {MIN_QUALITY}),
nn AS MATERIALIZED (SELECT a.pos, list(b.i) AS near FROM s a JOIN o b ON b.pos < a.pos WHERE a.canonical <> '' AND a.r1 IS NULL AND a.r2 IS NULL AND {q.jaccard('a.toks', 'b.toks')} >= {NEAR} GROUP BY a.pos),
gr AS (SELECT 0::BIGINT AS i, []::STRUCT(i BIGINT, pos BIGINT, url VARCHAR, host VARCHAR, category VARCHAR, print VARCHAR)[] AS chosen
  UNION ALL SELECT o.i, CASE WHEN len(chosen) < {MAX_DOCS} AND len(list_filter(chosen, lambda x: x.category = o.category)) < o.most AND len(list_filter(chosen, lambda x: x.host = o.host)) < {MAX_PER_DOMAIN} AND len(list_filter(chosen, lambda x: x.url = o.canonical OR x.print = o.print)) = 0
    AND NOT list_has_any(coalesce(nn.near, []::BIGINT[]), list_transform(chosen[greatest(1, len(chosen) - {WINDOW - 1}):], lambda x: x.i)) THEN list_append(chosen, {{'i': o.i, 'pos': o.pos, 'url': o.canonical, 'host': o.host, 'category': o.category, 'print': o.print}}) ELSE chosen END
  FROM gr JOIN o ON o.i = gr.i + 1 LEFT JOIN nn ON nn.pos = o.pos),
ok AS MATERIALIZED (SELECT arg_max(chosen, i) AS chosen FROM gr),
f AS MATERIALIZED (SELECT s.*, list_filter(chosen, lambda x: x.pos < s.pos) AS past, len(list_filter(chosen, lambda x: x.pos = s.pos)) > 0 AS own, coalesce(near, []::BIGINT[]) AS near FROM s, ok LEFT JOIN nn ON nn.pos = s.pos),
rej AS MATERIALIZED (SELECT *, CASE WHEN own THEN NULL WHEN len(past) >= {MAX_DOCS} THEN 'max_docs' WHEN len(list_filter(past, lambda x: x.category = f.category)) >= most THEN 'category_quota' WHEN canonical = '' THEN 'invalid_scheme_or_url' WHEN len(list_filter(past, lambda x: x.url = canonical)) > 0 THEN 'duplicate_url' WHEN r1 IS NOT NULL THEN r1
  WHEN len(list_filter(past, lambda x: x.host = f.host)) >= {MAX_PER_DOMAIN} THEN 'per_domain_cap' WHEN r2 IS NOT NULL THEN r2 WHEN list_has_any(near, list_transform(past[greatest(1, len(past) - {WINDOW - 1}):], lambda x: x.i)) THEN 'near_duplicate' WHEN len(list_filter(past, lambda x: x.print = f.print)) > 0 THEN 'fingerprint_duplicate' ELSE 'quality_threshold' END AS reason FROM f)"""


@query(f"WITH RECURSIVE {_REJECTED} SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM rej GROUP BY 1")
def reject_reasons(spark, sf_dir):
    return judged(spark, sf_dir)[1].groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH RECURSIVE {_REJECTED} SELECT substr(md5(canonical || '|' || title), 1, 16) AS id, canonical AS url, title, category, host AS source_domain, {q.detect_language('body')} AS language, round(quality, 4) AS quality_score, 'simple' AS extract_method,
  substr(sha1(array_to_string(list_sort(toks), ' ')), 1, 16) AS text_hash, md5(substr(body, 1, 22000)) AS text_md5 FROM rej WHERE reason IS NULL
""")
def web_corpus(spark, sf_dir):
    rows, verdicts = judged(spark, sf_dir)
    ids = verdicts.where("reason IS NULL").select("pos")
    rows = rows.join(few(ids), "pos", "left_semi")
    return rows.select(F.substring(F.md5(F.concat_ws("|", "canonical", "title").cast("binary")), 1, 16).alias("id"), C("canonical").alias("url"), "title", "category", C("host").alias("source_domain"), sc.detect_language(C("body")).alias("language"), F.round("quality", 4).alias("quality_score"), F.lit("simple").alias("extract_method"), F.substring(t.fingerprint(t.token_set(C("body"))), 1, 16).alias("text_hash"), F.md5(F.substring("body", 1, 22000).cast("binary")).alias("text_md5"))


@query(f"""
WITH RECURSIVE {_REJECTED}, dom AS (SELECT host AS name, count(*) AS n FROM rej WHERE reason IS NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 120)
SELECT 'domain' AS counter, name, n::BIGINT AS n FROM dom UNION ALL SELECT 'category', category, count(*) FROM rej WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'extractor', 'simple', count(*) FROM rej WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'origin', 'seed', count(*) FROM rej WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'rejected', reason, count(*) FROM rej WHERE reason IS NOT NULL GROUP BY 2
""")
def crawl_counters(spark, sf_dir):
    """Counters of a build: kept pages by category, origin, extractor and domain (the first 120), rejected ones by reason."""
    rows = judged(spark, sf_dir)[1]
    long = rows.select(F.explode(F.when(C("reason").isNotNull(), F.array(F.struct(F.lit("rejected").alias("counter"), C("reason").alias("name")))).otherwise(F.array(*[F.struct(F.lit(k).alias("counter"), v.alias("name")) for k, v in (("domain", C("host")), ("category", C("category")), ("extractor", F.lit("simple")), ("origin", F.lit("seed")))]))).alias("x"))
    counts = long.groupBy("x.counter", "x.name").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("counter <> 'domain'").unionByName(counts.where("counter = 'domain'").orderBy(C("n").desc(), "name").limit(120))


@query(f"WITH p AS (SELECT page_id, {q.host('url')} AS host, {q.canonical('url')} AS u FROM pages), d AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY page_id) AS seen FROM p), c AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rank FROM d WHERE seen = 1) SELECT page_id, host, rank::INT AS rank FROM c WHERE rank <= {MAX_PER_DOMAIN}")
def domain_caps(spark, sf_dir):
    rows = pages(spark, sf_dir, "page_id", "url").select("page_id", web.host(C("url")).alias("host"), web.canonical(C("url")).alias("u"))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("u").orderBy("page_id"))).where("seen = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))
    return rows.where(C("rank") <= MAX_PER_DOMAIN).select("page_id", "host", "rank")


@query(f"WITH h AS (SELECT {q.host('url')} AS host FROM pages) SELECT host, count(*)::BIGINT AS n FROM h GROUP BY 1 ORDER BY n DESC, host LIMIT 120")
def top_domains(spark, sf_dir):
    hosts = pages(spark, sf_dir, "page_id", "url").groupBy(web.host(C("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return hosts.orderBy(C("n").desc(), "host").limit(120)


_SHARES = "c AS (SELECT host, (row_number() OVER (ORDER BY n DESC, host) - 1)::INT AS i, n::DOUBLE AS w FROM (SELECT " + q.host("url") + " AS host, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, host LIMIT 12)"


def _shares(spark, sf_dir):
    """The twelve hosts with the most pages as categories, weighted by their pages."""
    hosts = pages(spark, sf_dir, "page_id", "url").groupBy(web.host(C("url")).alias("host")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = hosts.orderBy(C("weight").desc(), "host").limit(12)
    return hosts.withColumn("category", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(C("weight").desc(), "host")) - 1)


@query(f"""
WITH {_SHARES}, r AS (SELECT i, w, 137 * (w / (SELECT sum(greatest(0.05, w)) FROM c)::DOUBLE) AS raw FROM c),
b AS (SELECT i, w, raw, least(20, floor(raw)::BIGINT) AS base FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY base >= 20, raw - floor(raw) DESC, i) AS k, (SELECT 137 - sum(base) FROM b) AS left1 FROM b),
p AS (SELECT *, base + (base < 20 AND k <= left1)::BIGINT AS one FROM o),
s AS (SELECT *, row_number() OVER (ORDER BY one >= 20, w DESC, i) AS k2, (SELECT 137 - sum(one) FROM p) AS left2 FROM p)
SELECT i::INT AS category, (one + (one < 20 AND k2 <= left2)::BIGINT)::BIGINT AS quota FROM s
""")
def category_quota(spark, sf_dir):
    return category_quotas(_shares(spark, sf_dir).select("category", "weight"), max_docs=137, cap=20)


@query(f"""
WITH {_SHARES}, n AS (SELECT count(*) AS n FROM c), b AS (SELECT i, least(20, greatest(1, 137 // n))::BIGINT AS base, n FROM c, n), d AS (SELECT *, 137 - base * n AS rest FROM b)
SELECT i::INT AS category, (base + CASE WHEN rest > 0 AND i < rest AND base < 20 THEN 1 WHEN rest < 0 AND i < -rest AND base > 0 THEN -1 ELSE 0 END)::BIGINT AS quota FROM d
""")
def even_quota(spark, sf_dir):
    return even_quotas(_shares(spark, sf_dir).select("category"), max_docs=137, cap=20)


_LINKED = f"hl AS ({SQL['html_links']}), uc AS (SELECT page_id, {q.canonical('url')} AS url, regexp_extract({q.path('url')}, '{_CATEGORY}', 1) AS category FROM pages), g AS (SELECT DISTINCT uc.url AS src, link FROM hl JOIN uc USING (page_id) WHERE uc.url <> '')"


@query(f"""
WITH RECURSIVE {_LINKED}, f AS (SELECT DISTINCT category, url, 0 AS depth FROM uc WHERE url <> '' AND page_id % 3 > 0 UNION SELECT f.category, g.link, f.depth + 1 FROM f JOIN g ON g.src = f.url WHERE f.depth < 2),
m AS (SELECT category, url, min(depth)::INT AS depth FROM f GROUP BY ALL)
SELECT category, url, depth, (SELECT min(g.src) FROM g JOIN m s ON s.url = g.src AND s.category = m.category AND s.depth = m.depth - 1 WHERE g.link = m.url) AS via FROM m
""")
def crawl_frontier(spark, sf_dir):
    """What two steps over the pages' own links, 18 a page, reach in each category; two thirds of the pages are seeds."""
    own = pages(spark, sf_dir, "page_id", "url").select("page_id", web.canonical(C("url")).alias("url"), F.regexp_extract(web.path(C("url")), _CATEGORY, 1).alias("category")).where("url <> ''")
    links = html_links(spark, sf_dir).join(own.select("page_id", C("url").alias("src")), "page_id").select("src", "rank", "link")
    return frontier(own.where("page_id % 3 > 0"), links, depth=2)
