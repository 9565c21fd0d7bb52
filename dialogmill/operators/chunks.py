"""Chunks of profile sources and their retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.functions import constants as K
from dialogmill.functions import text as t
from dialogmill.operators.state import kept, small_enough

#: Up to so many query tokens they go to every task.
BROADCAST_TOKENS = 500_000
#: About so many chunks make a block of postings; blocks hold chunks of one of so many levels of age.
BLOCK_CHUNKS, AGE_LEVELS = 1024, 8
#: The rarest tokens of a query whose chunks give the first bound.
FIRST_TOKENS = 3


def chunk_texts(c: Column) -> Column:
    """Lines packed greedily into chunks of at most MAX_CHUNK_CHARS; one longer line stays whole."""
    def fold(a: Column, line: Column) -> Column:
        longer = F.concat(a["now"], F.lit("\n"), line)
        full = F.length(longer) > K.MAX_CHUNK_CHARS
        return F.when(a["now"] == "", F.struct(a["done"].alias("done"), line.alias("now"))).when(full, F.struct(F.array_append(a["done"], a["now"]).alias("done"), line.alias("now"))).otherwise(F.struct(a["done"].alias("done"), longer.alias("now")))

    lines = F.filter(F.transform(F.split(t.sanitize(c), "\n", -1), t.strip), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    packed = F.aggregate(lines, start, fold, lambda a: F.array_append(a["done"], a["now"]))
    return F.slice(F.filter(packed, lambda x: F.length(x) >= K.MIN_CHUNK_CHARS), 1, K.MAX_CHUNKS)


def chunks(sources: DataFrame) -> DataFrame:
    """source_id, source_type, updated_ms, chunk_no, chunk, tokens of sources (source_id, source_type, updated_ms, content)."""
    rows = sources.select("source_id", "source_type", "updated_ms", F.posexplode(chunk_texts(F.col("content"))).alias("chunk_no", "chunk"))
    return rows.withColumn("tokens", query_tokens(F.col("chunk")))


def query_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(t.speech(t.sanitize(c)), " "), lambda x: F.length(x) > 1))


def base_weight(source_type: Column, intent: Column | None = None, manual: dict[str, float] | None = None) -> Column:
    """Weight of a source type, times that of the intent and a manual one where there are any."""
    as_map = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])
    weight = F.coalesce(F.try_element_at(as_map(K.SOURCE_WEIGHT), source_type), F.lit(K.UNKNOWN_WEIGHT))
    if intent is not None:
        pairs = as_map({f"{i}|{s}": v for i, by in K.INTENT_MULTIPLIER.items() for s, v in by.items()})
        weight = weight * F.coalesce(F.try_element_at(pairs, F.concat_ws("|", intent, source_type)), F.lit(1.0))
    return weight * F.coalesce(F.try_element_at(as_map(manual), source_type), F.lit(1.0)) if manual else weight


def _kind(source_type: Column) -> Column:
    return F.when(source_type.isin([*K.SOURCE_WEIGHT]), source_type).otherwise("")


def _age(as_of_ms: int) -> Column:
    """What a chunk's age adds to its scores."""
    fresh = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(as_of_ms) - F.col("updated_ms")) / F.lit(86_400_000.0 * K.FRESH_DAYS)))
    return fresh * K.FRESHNESS_WEIGHT


def postings(chunked: DataFrame, as_of_ms: int = 0, tokens: DataFrame | None = None) -> DataFrame:
    """tok, kind, source_type, df, most_age, places: the chunks (source_id, chunk_no, age) with a token, in blocks of a source type and a level of age, each with the most that age adds there.

    A common token has many blocks, so no task holds all of its chunks. Store the table: queries read it. ``tokens`` (tok): an index for queries that ask for no others; of every chunk only these are shuffled.
    """
    rows = chunked.select("source_id", "chunk_no", "source_type", _kind(F.col("source_type")).alias("kind"), _age(as_of_ms).alias("age"), F.explode("tokens").alias("tok"))
    if tokens is not None:
        rows = rows.join(tokens, "tok", "left_semi")
    df = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    level = F.floor(F.col("age") * (AGE_LEVELS / K.FRESHNESS_WEIGHT))
    part = F.pmod(F.xxhash64("source_id", "chunk_no"), F.ceil(F.col("df") / BLOCK_CHUNKS))
    blocks = rows.join(df, "tok").groupBy("tok", "df", "kind", "source_type", level.alias("level"), part.alias("part"))
    return blocks.agg(F.max("age").alias("most_age"), F.collect_list(F.struct("source_id", "chunk_no", "age")).alias("places")).drop("level", "part")


def retrieve(chunked: DataFrame, queries: DataFrame, limit: int = 5, as_of_ms: int = 0, source_types: list[str] | None = None, manual: dict[str, float] | None = None, index: DataFrame | None = None) -> DataFrame:
    """rank, source_id, source_type, chunk_no, score of the best chunks of each query, with the query's keys; ties by source and chunk.

    queries: query, intent, keys (query_id and others) and, where queries differ in them, types (array of allowed source types) and most (limit).

    The best chunks by source and age alone, and those that share one of a query's rarest tokens, give a score that the result must reach. A chunk of
    a block that reaches it shares at least m of the query's n tokens, as the block's source and age add so much at most; so it has one of the n - m + 1 rarest, and
    of the index only such blocks are read, and their chunks scored. So common words pair nothing. Pass stored tables of chunks and postings(): they are read several times.
    """
    from pyspark.sql import Window

    keys = [c for c in queries.columns if c not in ("query", "intent", "types", "most")]
    place = ["source_id", "chunk_no"]
    kinds = F.array(*map(F.lit, [*K.SOURCE_WEIGHT, ""]))
    rows = chunked.select(*place, "source_type", _kind(F.col("source_type")).alias("kind"), _age(as_of_ms).alias("age"), "tokens")
    known = F.when(F.col("intent").isin([*K.INTENT_MULTIPLIER]), F.col("intent")).otherwise("")
    types = F.col("types") if "types" in queries.columns else F.array(*map(F.lit, source_types)) if source_types is not None else F.lit(None).cast("array<string>")
    most = F.col("most") if "most" in queries.columns else F.lit(limit)
    asked = kept(queries.select(*keys, known.alias("intent"), types.alias("types"), most.alias("most"), query_tokens(F.col("query")).alias("qt")), "queries")
    largest = asked.agg(F.max("most")).first()[0] or 1
    hits = asked.select(*keys, F.explode("qt").alias("tok"))
    small = F.broadcast if small_enough(hits, BROADCAST_TOKENS) else lambda x: x
    if index is None:
        index = kept(postings(chunked, as_of_ms, small(hits.select("tok").distinct())), "postings")
    df = index.join(small(hits.select("tok").distinct()), "tok", "left_semi").groupBy("tok").agg(F.max("df").alias("df"))
    ordered = hits.join(df, "tok").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("by"))
    asked = kept(asked.join(ordered, keys, "left").withColumn("by", F.coalesce("by", F.array().cast("array<struct<df:bigint,tok:string>>"))), "queries")
    allowed = lambda t: F.col("types").isNull() | F.array_contains("types", t)
    own = asked.select(*keys, "intent", "types", "most", "qt")

    def scored(met: DataFrame) -> DataFrame:
        lexical = F.when(F.size("qt") > 0, F.size(F.array_intersect("qt", "tokens")) / F.size("qt")).otherwise(0.0)
        base = base_weight(F.col("source_type"), F.col("intent"), manual)
        return met.where(allowed(F.col("source_type"))).select(*keys, "most", *place, "source_type", (base + lexical * K.LEXICAL_WEIGHT + F.col("age")).alias("score"))

    def exact(found: DataFrame) -> DataFrame:
        """Scores of found (keys, place)."""
        return scored(found.join(rows, place).join(small(own), keys))

    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), *place)
    best = lambda found: found.dropDuplicates([*keys, *place]).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= F.col("most")) & (F.col("rank") <= largest))
    # whatever is not among the best of its kind by age needs tokens to be in a result
    by_kind = Window.partitionBy("kind").orderBy(F.col("age").desc(), *place)
    top = kept(rows.withColumn("rn", F.row_number().over(by_kind)).where(F.col("rn") <= largest).drop("rn"), "best-by-age")
    plain = scored(own.withColumn("kind", F.explode(kinds)).join(top, "kind"))
    rarest = asked.select(*keys, F.explode(F.slice("by", 1, FIRST_TOKENS)).alias("x")).select(*keys, F.col("x.tok").alias("tok"))
    first = exact(index.join(small(rarest), "tok").select(*keys, F.explode("places").alias("p")).select(*keys, "p.source_id", "p.chunk_no").distinct())
    start = kept(best(first.unionByName(plain)), "first-best")
    bound = start.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    wanted = asked.join(bound, keys, "left").select(*keys, "intent", "types", F.greatest(F.lit(1), F.size("qt")).alias("size"), F.size("by").alias("found"), F.when(F.col("n") >= F.col("most"), F.col("least")).alias("least"), F.posexplode("by").alias("i", "x"))
    wanted = wanted.select(*keys, "intent", "types", "size", "found", "least", "i", F.col("x.tok").alias("tok"))
    # tokens that a chunk with this much of its own has to share; one at least, as those without any are among the best by age
    need = lambda own: F.greatest(F.lit(1), F.coalesce(F.ceil((F.col("least") - own - 1e-9) / K.LEXICAL_WEIGHT * F.col("size")), F.lit(1)))
    base = base_weight(F.col("source_type"), F.col("intent"), manual)
    read = index.select("tok", "source_type", "most_age", "places").join(small(wanted), "tok").where(allowed(F.col("source_type")))
    read = read.where(F.col("i") <= F.col("found") - need(base + F.col("most_age")))
    met = read.select(*keys, F.explode("places").alias("p")).select(*keys, "p.source_id", "p.chunk_no").distinct()
    ranked = best(exact(met).unionByName(start.drop("rank")))
    return ranked.select(*keys, "rank", "source_id", "source_type", "chunk_no", F.round("score", 4).alias("score"))


#: (limit, source types) of the two parts of a context, by intent; ``always`` is the policy that takes no account of the intent.
MIXES = {
    "technical_general": ((5, ("knowledge_base", "web_corpus", "glossary")), (2, ("github", "note"))),
    "candidate_specific": ((6, ("job_desc", "cv", "github", "linkedin", "note")), (1, ("knowledge_base", "web_corpus", "glossary"))),
    "mixed": ((4, ("job_desc", "cv", "github", "linkedin", "note")), (3, ("knowledge_base", "web_corpus", "glossary"))),
    "always": ((5, ("job_desc", "cv", "github", "linkedin", "note")), (2, ("knowledge_base", "web_corpus", "glossary"))),
}


def context_mix(chunked: DataFrame, queries: DataFrame, as_of_ms: int = 0, most: int = 7, manual: dict[str, float] | None = None, index: DataFrame | None = None) -> DataFrame:
    """query_id, context: the lines of both parts of the mix of each query (query_id, query, intent, policy), without repeats, ``most`` at most.

    The policy ``always`` has a mix of its own, scored as for mixed questions.
    """
    from dialogmill.functions import similarity as sim

    mix = F.when(F.col("policy") == "always", "always").when(F.col("intent").isin([*MIXES]), F.col("intent")).otherwise("mixed")
    parts = F.create_map(*[x for name, two in MIXES.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(n).alias("most"), F.array(*map(F.lit, types)).alias("types")) for n, types in two]))])
    asked = queries.withColumn("intent", F.when(mix == "always", "mixed").otherwise(F.col("intent"))).withColumn("parts", F.element_at(parts, mix))
    asked = asked.select("query_id", "query", "intent", F.posexplode("parts").alias("part", "x")).select("query_id", "part", "query", "intent", "x.most", "x.types")
    both = retrieve(chunked, asked, as_of_ms=as_of_ms, manual=manual, index=index).join(chunked.select("source_id", "chunk_no", "chunk"), ["source_id", "chunk_no"])
    line = F.concat(F.lit("[profile:"), F.col("source_type"), F.lit("] "), t.clip(F.col("chunk"), 220))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "rank", line.alias("line")))), lambda x: x["line"])
    return both.groupBy("query_id").agg(F.array_join(sim.combine_unique(lines, most), "\n").alias("context"))
