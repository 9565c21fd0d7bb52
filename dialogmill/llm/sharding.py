"""Sharding by balanced label propagation, in built-in functions only.

Documents of a group (here: equal texts) are linked to one another. Every linked document starts in
the shard that its id's hash names. In each round the members of a group ask to move to the group's
leading shard among those with room for them; a shard admits movers, those that gain most first, up
to its free places, until nothing moves. Documents without links have nothing to lose and fill what is left, so that the
row counts of any two shards differ by one at most, whatever the groups.

Members that start in one shard move together, so a round handles (group, start) units; of a large
group PIECES for each shard: a group with a third of all rows is a few hundred units.

Nulls: a null text counts as the empty text, so null and empty texts are one group; null ids hash
like -1. Repeated rows are linked and are placed one by one. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import bucket_bits, materialize, ranked, table, text_of

SHARDS = 24
#: Units of a group that could take a PIECES-th of a shard are dealt into so many, so that they fill a shard's room.
PIECES = 32


def quota(n_rows: int, n_shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def propagate(units: DataFrame, quotas: list[int]) -> DataFrame:
    """units: g1, g2 (group), start, piece, n, with a ``shard`` that begins as ``start`` -> the same with the shard where nothing moves any more.

    A unit asks for the leading one among the group's shards that have room for it. Members only move to shards
    ahead of theirs, and the first unit of each target's queue always fits, so the rounds end.
    """
    keys = ["g1", "g2", "start", "piece"]
    bits = bucket_bits(units.count())
    while True:
        load = units.groupBy("shard").agg(F.sum("n").alias("n"))
        used = {r["shard"]: r["n"] for r in load.collect()}  # a row for each shard
        free = F.array(*[F.lit(q - used.get(s, 0)).cast("long") for s, q in enumerate(quotas)])
        held = units.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("held"))
        # most members first, ties by a hash
        choice = F.struct("held", F.xxhash64("g1", "g2", "shard").alias("tie"), F.col("shard").alias("to"))
        led = held.groupBy("g1", "g2").agg(F.collect_list(choice).alias("choices"))
        asked = units.join(led, ["g1", "g2"]).withColumn("own", F.filter("choices", lambda x: x["to"] == F.col("shard"))[0])
        fit = F.filter("choices", lambda x: (x > F.col("own")) & (F.element_at(free, x["to"] + 1) >= F.col("n")))
        asked = asked.withColumn("best", F.array_max(fit)).where("best IS NOT NULL")
        asked = asked.select(*keys, "n", F.col("best.to").alias("target"), (F.col("best.held") - F.col("own.held") + 1).alias("gain")).withColumn("room", F.element_at(free, F.col("target") + 1))
        # larger gains first by powers of two, then whole groups in the order of a hash
        step = F.lit(63) - F.floor(F.log2(F.col("gain").cast("double")))
        asked = asked.withColumn("h", F.xxhash64("g1", "g2")).withColumn("bucket", step * (1 << bits) + F.shiftrightunsigned("h", 64 - bits) if bits else step)
        asked = asked.withColumn("u", F.expr("shiftrightunsigned(h, 1)"))
        admitted = ranked(asked, ["target"], ["bucket", "u", "h", "start", "piece"], "bucket", "r", "n", "taken").where("taken <= room")
        moves = materialize(admitted.select(*keys, F.col("target").alias("to")), "shard-moves")
        if moves.isEmpty():
            return units
        units = materialize(units.join(moves, keys, "left").select(*keys, "n", F.coalesce("to", "shard").alias("shard")), "shard-units")


def shard_rows(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id", (F.octet_length("t") + 8).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), F.xxhash64("t").alias("g1"), F.xxhash64(F.lit("second"), "t").alias("g2"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("place")).alias("u"))
    rows = materialize(rows.withColumn("start", F.pmod("u", F.lit(n_shards)).cast("int")), "shard-rows")
    n_rows = rows.count()
    quotas, bits = quota(n_rows, n_shards), bucket_bits(n_rows)
    # at most n_shards * PIECES groups are this large
    large = rows.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > max(PIECES, n_rows // (n_shards * PIECES))).select("g1", "g2", F.lit(True).alias("large"))
    piece = F.when(F.col("large"), F.pmod(F.shiftrightunsigned("u", 20), F.lit(PIECES)).cast("int")).otherwise(0)
    rows = materialize(rows.join(F.broadcast(large), ["g1", "g2"], "left").withColumn("piece", piece).drop("large"), "shard-rows")
    groups = rows.groupBy("g1", "g2", "start", "piece").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.join(groups.groupBy("g1", "g2").agg(F.sum("n").alias("all")).where("all > 1").select("g1", "g2"), ["g1", "g2"])
    units = materialize(groups.withColumn("shard", F.col("start")), "shard-units")
    units = propagate(units, quotas)

    labels = units.select(F.col("g1").alias("a"), F.col("g2").alias("b"), F.col("start").alias("c"), F.col("piece").alias("d"), F.col("shard").alias("label"))
    rows = rows.join(labels, (F.col("g1") == F.col("a")) & (F.col("g2") == F.col("b")) & (F.col("start") == F.col("c")) & (F.col("piece") == F.col("d")), "left").drop("a", "b", "c", "d")
    rows = materialize(rows.withColumn("label", F.coalesce("label", F.lit(-1))), "shard-labels")
    # linked rows keep whole groups side by side: numbered by the group's hash; a hot group is dealt by the rows' own hash
    spread = lambda c: F.shiftrightunsigned(c, 64 - bits) if bits else F.lit(0).cast("long")
    within = 5 + bits // 2
    linked = rows.where("label >= 0").withColumn("bucket", spread(F.col("g1")) * (1 << within) + F.shiftrightunsigned("u", 64 - within))
    linked = ranked(linked, ["label"], ["bucket", "g1", "g2", "u", "doc_id"], "bucket", "r").drop("bucket")
    caps = F.array(*[F.lit(q).cast("long") for q in quotas])
    linked = materialize(linked.withColumn("stays", F.col("r") < F.element_at(caps, F.col("label") + 1)), "shard-linked")
    kept = {r["label"]: r["n"] for r in linked.where("stays").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # everything else is numbered once and dealt to the shards' free places
    rest = rows.where("label < 0").withColumn("linked", F.lit(False)).unionByName(linked.where("NOT stays").withColumn("linked", F.lit(True)).drop("r", "stays"))
    rest = rest.withColumn("one", F.lit(1)).withColumn("bucket", spread(F.col("u")))
    rest = ranked(rest, ["one"], ["bucket", "u", "doc_id"], "bucket", "g")
    free, first, at = [], [], 0
    for s, q in enumerate(quotas):
        free.append(q - kept.get(s, 0))
        first.append(at)
        at += free[-1]
    starts = F.array(*[F.lit(x).cast("long") for x in first])
    base = F.array(*[F.lit(kept.get(s, 0)).cast("long") for s in range(n_shards)])
    # the last shard whose first number isn't beyond g and that has a free place
    choices = F.array(*[F.struct(F.lit(first[s]).cast("long").alias("f"), F.lit(s).alias("s")) for s in range(n_shards) if free[s]] or [F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).alias("s"))])
    shard = F.aggregate(choices, F.lit(0), lambda a, c: F.when(c["f"] <= F.col("g"), c["s"]).otherwise(a))
    rest = rest.withColumn("shard", shard).withColumn("slot", F.element_at(base, F.col("shard") + 1) + F.col("g") - F.element_at(starts, F.col("shard") + 1))
    linked = linked.where("stays").select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), F.col("r").alias("slot"), F.lit(True).alias("linked"))
    out = linked.unionByName(rest.select("doc_id", "size", "text_crc32", "shard", "slot", "linked"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "linked")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
