"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are 64 bits over 3-word shingles. Fingerprints link at ``RADIUS`` or fewer differing
bits; a component is what links reach.

Candidates: bit b of the fingerprint carries a nonzero vector m(b) of RADIUS + 1 bits, and the table
of a nonzero vector v keeps the bits with odd <m(b), v>. The vectors m of three differing bits span
at most three of four dimensions, so some v is orthogonal to all three and that table sees equal keys:
every pair within the radius collides in one of the 15 tables, without exception.

Equal fingerprints are one class and meet the tables once, so copies cost nothing. A bucket's links
are found by a search that visits each member once and emits at most one link for each member, not
all pairs. A bucket with over ``most`` classes is dealt anew by 15 masks over the bits that its
table leaves free; what is then still together differs in about 15 bits only, hence is bounded, and
pairs within the radius still all meet.

Nulls: a null text counts as the empty text; texts without a word have the fingerprint zero, which
links like any other. Null ids are passed over when the smallest id is taken; a component of only null
ids has a null id. Repeated rows give equal rows. Texts are taken whole, whatever their length; a bit set in exactly half of the
hashes is 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import materialize, prepare_python, table
from dialogmill.llm.shingles import shingle_sets, similar_links, words_of

RADIUS = 3
SEED = 42
MOST = 4096
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    return fingerprint_of(words_of(text))


def fingerprint_of(words: list[bytes]) -> int:
    import xxhash

    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - 2
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + 2]
        h = np.array([digest(b"%b %b %b" % three, SEED) for three in zip(part, part[1:], part[2:])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * total > n).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), fp (the fingerprint as a signed long)."""
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "t", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "xxhash64(text) t").mapInArrow(run, "doc_id long, t long, fp long")


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits, over the given bits, as signed longs."""
    n = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, n + 1):
        mask = sum(1 << b for i, b in enumerate(bits) if bin((i % n + 1) & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


FIRST = masks(list(range(64)))


def free_masks() -> list[list[int]]:
    """For each first table the masks over the bits that it leaves free."""
    return [masks([b for b in range(64) if not (m >> b) & 1]) for m in FIRST]


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius: a search over the distinct fps, one link for each one reached."""
    left = fps.view(np.uint64)
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(left ^ one) <= radius
            if near.any():
                reached = left[near]
                a.append(np.full(len(reached), one, np.uint64))
                b.append(reached)
                front.extend(reached)
                left = left[~near]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a) if a else empty).view(np.int64), (np.concatenate(b) if b else empty).view(np.int64)


def _links(groups: DataFrame) -> DataFrame:
    """groups: t, k, fp, all rows of a (t, k) in one partition, in order -> a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(fps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if sum(map(len, fps)) > 1:
                a, b = bucket_links(np.concatenate(fps))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(t):
                continue
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(t)], strict=True):
                if last != (t[lo], k[lo]):
                    yield from closed(held)
                    last, held = (t[lo], k[lo]), []
                held.append(fp[lo:hi])
        yield from closed(held)

    return groups.mapInArrow(run, "a long, b long")


def tables(classes: DataFrame) -> DataFrame:
    """t, k, fp: each class in each first table."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(FIRST)])
    return classes.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp")


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: enough links between the distinct fps to connect all pairs within the radius."""
    spread = tables(classes)
    sizes = spread.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = materialize(spread.join(sizes, ["t", "k"]), "simhash-tables")
    small = sized.where(F.col("n") <= most).select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")
    found = _links(small)
    large = sized.where(F.col("n") > most).select("t", "k", "fp")
    if not large.isEmpty():
        inner = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in free_masks()])
        finer = large.select("t", "k", "fp", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("t2", "m"))
        finer = finer.select((F.col("t") * 16 + F.col("t2")).alias("t"), F.col("k").bitwiseOR(F.col("fp").bitwiseAND(F.col("m"))).alias("k"), "fp")
        found = found.unionByName(_links(finer.repartition("t", "k").sortWithinPartitions("t", "k")))
    return found


def components(edges: DataFrame, label: str = "simhash") -> DataFrame:
    """node, root (the smallest node of its component) of all nodes with an edge.

    Alternates large and small stars (Kiveris et al., Connected components in MapReduce and beyond):
    each round points the larger neighbours of a node, then the smaller ones, at its smallest neighbour.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = state(edges)
    while seen[0]:
        # large star: from each node the larger neighbours go to the smallest of node and neighbours
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("__a"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("__a")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest neighbour
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("__b"), "m")
        small = large.join(least, F.col("b") == F.col("__b")).select(F.col("m").alias("a"), F.explode(F.array(F.col("a"), F.col("b"))).alias("b"))
        edges = materialize(small.where("a <> b").distinct(), f"{label}-stars")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_components(docs: DataFrame, most: int = MOST, similar: float | None = None) -> DataFrame:
    """doc_id, t (hash of the text), fp, component_id and keeper for every row of ``docs`` (doc_id, text).

    ``keeper`` is true for one document of each component: the smallest (doc_id, t), null ids last, with its repeated rows.
    With ``similar``, texts whose five-word shingles have at least this Jaccard similarity are linked as well.
    """
    sets = materialize(fingerprints(docs) if similar is None else shingle_sets(docs, similar), "simhash-prints")
    prints = sets.select("doc_id", "t", "fp")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("one")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), one), "simhash-classes")
    found = links(classes.select("fp"), most)
    star = components(found if similar is None else found.unionByName(similar_links(sets, docs, similar)))
    rooted = classes.join(star, F.col("fp") == F.col("node"), "left").select("fp", "first", "one", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("one").alias("one"))
    by_class = materialize(rooted.drop("one").join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id", "one"), "simhash-components")
    keeper = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("t") == F.col("one.t"))
    return prints.join(by_class, F.col("fp") == F.col("__fp")).select("doc_id", "t", "fp", "component_id", keeper.alias("keeper"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
