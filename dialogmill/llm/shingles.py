"""Exact near-duplicate links: Jaccard similarity of the sets of five-word shingles.

Candidates by prefix filtering: under any fixed order of shingles, two sets with similarity t or more share one of
their first n - ceil(t * n) + 1 ones, and at the first shared place enough of both sets is left for the overlap that t
asks for (Bayardo et al. 2007; Xiao et al. 2008). Shingles that are frequent in a sample come last; the sample sets the order only, so it
bears on speed, not on the result.

Equal sets are one class. Buckets (classes that share a prefix shingle) with over ``LARGE`` members are first compared with
PIVOTS members each, which makes rows in proportion to the members. Then the pairs of a bucket that still lie in different
components are compared by sizes, places and signatures, whose distance is at most that of the sets: small buckets by a
join, others in blocks of ``BLOCK`` by ``BLOCK`` members, so that no task holds a whole bucket; only what these leave is emitted and
compared by the sets. So every pair at the threshold ends in one component.

A text of one to four words is one shingle; a text without words has no similar one here.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import materialize, prepare_python

WIDTH = 5
SIMILAR = 0.8
#: Buckets up to SMALL are joined; from LARGE on they are compared with PIVOTS members first.
SMALL, LARGE, PIVOTS, BLOCK = 16, 512, 8, 1024
BITS = 512
#: Documents of the sample, about; frequent shingles that are kept of it, at most.
SAMPLE, OFTEN = 8192, 65_536
STEP = 100
BROADCAST_ROWS = 200_000
SEED = 43
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles: the words' XXH64 are mixed in order."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, SEED) for w in words], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ (out >> np.uint64(29)) ^ h[k : k + n]) * _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix(found: np.ndarray, often: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of the order: those not in ``often`` (sorted) by hash, then the others by their ``place``."""
    n = len(found)
    size = n - ceil(n * threshold - 1e-9) + 1 if n else 0
    if not len(often):
        return found[:size]
    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
    late = often[at] == found
    if n - late.sum() >= size:
        return found[~late][:size]
    return np.concatenate([found[~late], found[late][np.argsort(place[at[late]])]])[:size]


def signature(found: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in parts: two sets' signatures differ in no more bits than the sets in shingles.

    Larger sets have 8 or 64 times BITS parts; combining every 8th (64th) word gives the signature of BITS.
    """
    bits = BITS * (1 if len(found) <= BITS else 8 if len(found) <= 8 * BITS else 64)
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sig: Column, words: Column) -> Column:
    """A signature brought down to ``words`` words."""
    def combined(j: Column) -> Column:
        return F.aggregate(F.filter(sig, lambda x, i: i % words == j), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    return F.when(F.size(sig) == words, sig).otherwise(F.transform(F.sequence(F.lit(0), words - 1), combined))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of several texts of a sample, sorted; their places by frequency). Counted on the executors; at most OFTEN come back."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            found = [shingles(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["h"])

    picked = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    top = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.col("n").desc(), "h").limit(OFTEN)
    rows = sorted((r["h"] % (1 << 64), r["n"]) for r in top.collect())
    often, n = np.array([h for h, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)
    place = np.empty(len(rows), np.int64)
    place[np.lexsort((often, n))] = np.arange(len(rows))
    return often, place


def shingle_digests(docs: DataFrame) -> DataFrame:
    """c (digest of the set), s (the set) of every row of ``docs`` (doc_id, text)."""
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            sets = [shingles(words_of(t)) for t in batch.column(0).to_pylist()]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["c", "s"])

    return docs.select("text").mapInArrow(run, "c long, s array<long>")


def shingle_sets(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """doc_id, t (hash of the text), fp, c (digest of the set), n, p (its prefix), sig (its signature) of every row of ``docs`` (doc_id, text)."""
    from dialogmill.llm.simhash import fingerprint_of

    spark = docs.sparkSession
    prepare_python(spark)
    sent = spark.sparkContext.broadcast(frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often, place = sent.value
        for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            fps = np.array([fingerprint_of(w) for w in words], np.uint64).view(np.int64)
            sets = [shingles(w) for w in words]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            firsts = pa.array([prefix(s, often, place, threshold).view(np.int64) for s in sets], pa.list_(pa.int64()))
            signs = pa.array([signature(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps), pa.array(digests), pa.array([len(s) for s in sets], pa.int32()), firsts, signs], names=["doc_id", "t", "fp", "c", "n", "p", "sig"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "xxhash64(text) t").mapInArrow(run, "doc_id long, t long, fp long, c long, n int, p array<long>, sig array<long>")


def _sized(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9


def _reaches(n: Column, i: Column, m: Column, j: Column, threshold: float) -> Column:
    """What is left from the places i and j on suffices; holds at the first shared shingle of a similar pair."""
    return F.least(n - i, m - j) >= (n + m) * (threshold / (1 + threshold)) - 1e-6


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) of classes whose signatures leave the similarity possible."""
    side = lambda name, n, sig: classes.select(F.col("c").alias(name), F.col("n").alias(n), F.col("sig").alias(sig))
    both = pairs.distinct().join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b")
    both = both.withColumn("words", F.least(F.size("sa"), F.size("sb")))
    both = both.withColumn("sa", folded(F.col("sa"), F.col("words"))).withColumn("sb", folded(F.col("sb"), F.col("words")))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.where(differ <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, label: str) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by the sets of one text of each, computed again."""
    pairs = materialize(pairs, f"{label}-candidates")
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes.select("c", "id"), "c"), f"{label}-asked")
    n = asked.count()
    chosen = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(_small(asked.select(F.col("id").alias("__id")).distinct(), n), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    sets = shingle_digests(chosen).join(_small(asked.select("c"), n), "c", "left_semi").dropDuplicates(["c"])
    sets = materialize(sets, f"{label}-sets")
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(shared >= (F.size("x") + F.size("y") - shared) * threshold - 1e-9).select("a", "b"), f"{label}-links")


def similar_links(sets: DataFrame, docs: DataFrame, threshold: float = SIMILAR, small: int = SMALL, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """a, b (fingerprints): enough links to connect all rows of ``sets`` (those of ``docs``) at ``threshold`` or more."""
    from dialogmill.llm.simhash import components

    label = "shingles"
    classes = materialize(sets.where("n > 0").groupBy("c").agg(F.min("fp").alias("fp"), F.max("fp").alias("most"), F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("sig").alias("sig")), f"{label}-classes")
    keys = classes.select("c", "n", F.posexplode("p").alias("i", "h"))
    sizes = classes.select(F.explode("p").alias("h")).groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("members")).where("members > 1")
    left = materialize(keys.join(sizes, "h").withColumn("root", F.col("c")), f"{label}-buckets")
    links = None
    hot = left.where(F.col("members") > large)
    if not hot.isEmpty():
        picks = F.array_distinct(F.array(*[F.min_by(F.struct("c", "n", "i"), F.xxhash64("c", F.lit(k))) for k in range(PIVOTS)]))
        pairs = hot.join(hot.groupBy("h").agg(picks.alias("picks")), "h").select("c", "n", "i", F.explode("picks").alias("o"))
        pairs = pairs.where((F.col("c") != F.col("o.c")) & _sized(F.col("n"), F.col("o.n"), threshold) & _reaches(F.col("n"), F.col("i"), F.col("o.n"), F.col("o.i"), threshold))
        links = _verified(_likely(pairs.select(F.least("c", "o.c").alias("a"), F.greatest("c", "o.c").alias("b")), classes, threshold), classes, docs, threshold, label)
        left = _unsettled(left, components(links, label), label)
    found = _joined(left.where(F.col("members") <= small), threshold)
    many = left.where(F.col("members") > small)
    if not many.isEmpty():
        found = found.unionByName(_blocked(many.join(classes.select("c", folded(F.col("sig"), F.lit(BITS // 64)).alias("sig")), "c"), threshold, block))
    found = _verified(_likely(found, classes, threshold), classes, docs, threshold, label)
    links = found if links is None else links.unionByName(found)
    print_of = classes.select("c", "fp")
    out = links.join(print_of.select(F.col("c").alias("a"), F.col("fp").alias("fa")), "a").join(print_of.select(F.col("c").alias("b"), F.col("fp").alias("fb")), "b")
    same = sets.select("c", F.col("fp").alias("fb")).distinct().join(classes.where("fp <> most").select("c", F.col("fp").alias("fa")), "c")
    return out.select(F.col("fa").alias("a"), F.col("fb").alias("b")).unionByName(same.select(F.col("fa").alias("a"), F.col("fb").alias("b")))


def _joined(buckets: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs of small buckets (h, c, n, i, root)."""
    x = buckets.select("h", "c", "n", "i", "root")
    y = buckets.select(F.col("h").alias("__h"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"))
    on = (F.col("h") == F.col("__h")) & (F.col("c") < F.col("d")) & (F.col("root") != F.col("other")) & _sized(F.col("n"), F.col("m"), threshold) & _reaches(F.col("n"), F.col("i"), F.col("m"), F.col("j"), threshold)
    return x.join(y, on).select(F.col("c").alias("a"), F.col("d").alias("b"))


def _blocked(buckets: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b of the pairs of buckets (h, members, c, n, i, root, sig) that sizes, places, components and signatures leave possible.

    A bucket is dealt into blocks; each pair of blocks, and each block with itself, is one group of at most about 2 * ``block`` rows.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    rows = buckets.withColumn("own", F.pmod(F.xxhash64("c", F.lit("block")), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("k"), side.alias("side"), "c", "n", "i", "root", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def compare(parts: list[tuple]) -> None:
            side, c, n, i, root, sig = (np.concatenate(x) for x in zip(*parts))
            own = np.flatnonzero(side < 2)
            for x in own:
                rest = np.flatnonzero(side == 2) if side[x] else np.arange(x + 1, len(c))
                rest = rest[root[rest] != root[x]]
                m = n[rest]
                rest = rest[(np.minimum(m, n[x]) >= np.maximum(m, n[x]) * threshold - 1e-9) & (np.minimum(m - i[rest], n[x] - i[x]) >= (m + n[x]) * (threshold / (1 + threshold)) - 1e-6)]
                differ = np.bitwise_count(sig[rest] ^ sig[x]).sum(axis=1, dtype=np.int64)
                rest = rest[differ <= (n[rest] + n[x]) * ((1 - threshold) / (1 + threshold)) + 1e-6]
                if len(rest):
                    out.append(np.stack([np.minimum(c[rest], c[x]), np.maximum(c[rest], c[x])]))

        def emit() -> pa.RecordBatch:
            both = np.unique(np.concatenate(out, axis=1), axis=1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, side, c, n, i, root = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(6))
            sig = batch.column(6).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(k), -1)
            cuts = (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(k)], strict=True):
                if held and last != k[lo]:
                    compare(held)
                    held = []
                last = k[lo]
                held.append((side[lo:hi], c[lo:hi], n[lo:hi].astype(np.int64), i[lo:hi].astype(np.int64), root[lo:hi], sig[lo:hi]))
            if len(out) > 10_000:
                yield emit()
        if held:
            compare(held)
        if out:
            yield emit()

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long")


def _unsettled(buckets: DataFrame, star: DataFrame, label: str) -> DataFrame:
    """The rows (h, c, n, i, members, root) of the buckets that hold several components."""
    rooted = buckets.drop("root").join(star.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = materialize(rooted, f"{label}-rooted")
    several = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    return rooted.join(several, "h", "left_semi")
