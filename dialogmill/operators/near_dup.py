"""Near-duplicate token sets: an exact similarity join by prefix filtering, and keep-first resolutions.

Tokens are ordered by rarity; two sets with Jaccard similarity t or more share one of their first
len - ceil(t * len) + 1 tokens, and at the first shared one enough of both sets is left for the overlap that t asks for
(Bayardo et al. 2007; Xiao et al. 2008). Equal sets are collapsed before, so copies never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.functions import similarity as s
from dialogmill.operators.state import kept
from dialogmill.streaming.run import send_package

#: So many of the most frequent tokens have their frequencies broadcast.
BROADCAST_TOKENS = 500_000
#: Parities of a set's tokens, in words of 64.
BITS = 128


def set_classes(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """fp, first (smallest doc_id), tokens of each distinct nonempty set."""
    rows = docs.where(F.size(tokens) > 0).select("doc_id", F.sort_array(tokens).alias("tokens"))
    rows = rows.withColumn("fp", F.sha1(F.array_join("tokens", " ").cast("binary")))
    return rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("tokens").alias("tokens"))


def parities(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of BITS bits for each of ``n`` sets: each bit is the parity of the set's tokens (hashes ``h`` of the sets ``row``) dealt to it.

    Two sets' words differ in no more bits than the sets differ in tokens.
    """
    out = np.zeros((n, BITS // 64), np.uint64)
    np.bitwise_xor.at(out, (row, (h >> np.uint64(6)) % np.uint64(BITS // 64)), np.uint64(1) << (h & np.uint64(63)))
    return out


def order_of(freq: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Hashes, sorted, and frequencies of the ``most`` most frequent tokens of freq (h, df) at most, and whether all others occur once."""
    sizes = sorted(((r["df"], r["n"]) for r in freq.where("df > 1").groupBy("df").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = None, 0
    for df, n in sizes:
        held += n
        if held > most:
            break
        least = df
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), not sizes
    found = freq.where(F.col("df") >= least).select("h", "df").toArrow()
    h, df = found["h"].to_numpy().view(np.uint64), found["df"].to_numpy()
    by = np.argsort(h)
    return h[by], df[by], held <= most


def prefixes(sets: DataFrame, threshold: float, most: int = BROADCAST_TOKENS) -> DataFrame:
    """first, n (tokens), i (place), h (token), s0, s1 (parities) of the rarest tokens of each set (first, tokens): sets that are similar share one. Written once.

    Any order of the tokens will do: those of the broadcast frequencies come by these, the rest before them by hash. So a set is a row of one task, and
    nothing but the count of the tokens is shuffled. Where the frequencies have all tokens that two sets share, the others are left out.
    """
    send_package(sets.sparkSession)
    hashed = sets.select("first", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hs"))
    freq = kept(hashed.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")), "near-tokens")
    sent = sets.sparkSession.sparkContext.broadcast(order_of(freq, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, whole = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            signs = parities(h, row, len(n))
            often = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                often = np.where(known[at] == h, df[at], 0)
            by = np.lexsort((h, often, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            size = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            use = place < size[row]
            if whole:
                use &= often[by] > 0
            row, place, h = row[use], place[use], h[by][use]
            first = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first[row], n[row].astype(np.int32), place.astype(np.int32), h.view(np.int64), signs[row, 0].view(np.int64), signs[row, 1].view(np.int64))], names=["first", "n", "i", "h", "s0", "s1"])

    return kept(hashed.mapInArrow(run, "first long, n int, i int, h long, s0 long, s1 long"), "near-prefixes")


def likely(left: DataFrame, right: DataFrame, threshold: float, once: bool = False) -> DataFrame:
    """The distinct a, b of ``left`` and ``right``, both rows of prefixes(), whose sizes, places and parities leave the similarity possible."""
    other = right.select(F.col("first").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("h").alias("k"), F.col("s0").alias("r0"), F.col("s1").alias("r1"))
    near = (F.col("first") < F.col("b") if once else F.col("first") != F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9)
    reach = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= (F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-6
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("r0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("r1"))) <= (F.col("n") + F.col("m")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return left.join(other, (F.col("h") == F.col("k")) & near & reach & differ).select(F.col("first").alias("a"), "b").distinct()


def matched(left: DataFrame, right: DataFrame, sets: DataFrame, threshold: float, once: bool = False) -> DataFrame:
    """a, b, similarity of the similar sets of which a is in ``left`` and b in ``right``, both rows of prefixes(); ``once``: only a < b."""
    found = likely(left, right, threshold, once)
    found = found.join(sets.select(F.col("first").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("first").alias("b"), F.col("tokens").alias("tb")), "b")
    return found.withColumn("similarity", s.jaccard(F.col("ta"), F.col("tb"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def similar_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b (first ids, a < b), similarity of all pairs of classes at ``threshold`` or more."""
    sets = kept(classes.select("first", "tokens"), "near-sets")
    prefix = prefixes(sets, threshold)
    return matched(prefix, prefix, sets, threshold, once=True)


def resolve_any(pairs: DataFrame) -> DataFrame:
    """doc_id of each class with an earlier similar one."""
    return pairs.select(F.col("b").alias("doc_id")).distinct()


def resolve_greedy(pairs: DataFrame) -> DataFrame:
    """doc_id of each class with an earlier similar one that is itself kept.

    Rounds over the links: who has no undecided earlier neighbour is kept, and its later neighbours drop,
    until no links are left. The links are written each round.
    """
    left = kept(pairs.select("a", "b").distinct(), "near-links")
    dropped = None
    while not left.isEmpty():
        later = left.select(F.col("b").alias("a")).distinct()
        first = left.join(later, "a", "left_anti")
        out = kept(first.select(F.col("b").alias("doc_id")).distinct(), "near-dropped")
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = out.select(F.col("doc_id").alias("x"))
        decided = gone.unionByName(first.select(F.col("a").alias("x"))).distinct()
        left = kept(left.join(gone, left.b == gone.x, "left_anti").join(decided, left.a == decided.x, "left_anti"), "near-links")
    return dropped if dropped is not None else pairs.select(F.col("b").alias("doc_id")).limit(0)
