"""Three exact percentiles: values at places of a sorted group.

No task sorts a group. Splitters (approximate quantiles, a partial aggregate) deal a group's values into ranges; the counts of the
ranges tell which one holds a place, and only these ranges are sorted, by their distinct values.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogmill.operators import scan

from dialogmill.operators.state import small_enough

RANGES = 64
#: Up to so many groups their splitters and ranges are broadcast.
BROADCAST_GROUPS = 10_000


def ranked_values(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys, a column for each named place (counted from 0, over the column __n), and count: values at places of the sorted group.

    Null values don't count. Splitters only decide how even the ranges are, never the result.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 4 * RANGES)).alias("__cuts"))
    small = F.broadcast if small_enough(cuts, BROADCAST_GROUPS) else lambda x: x
    same = lambda name: [F.col(k).eqNullSafe(F.col(f"__{name}{i}")) for i, k in enumerate(keys)]
    as_right = lambda x, name: x.select(*[F.col(k).alias(f"__{name}{i}") for i, k in enumerate(keys)], *[c for c in x.columns if c not in keys])
    # a range ends with its splitter, so equal values share one
    dealt = rows.join(small(as_right(cuts, "c")), _all(same("c"))).select(*keys, "__v", F.size(F.filter("__cuts", lambda x: x < F.col("__v"))).alias("__r"))
    sizes = dealt.groupBy(*keys, "__r").agg(F.count(F.lit(1)).alias("__k"))
    # at most RANGES rows a group
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("__upto", F.sum("__k").over(group.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__k").over(group))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), p.cast("long").alias("at")) for name, p in places.items()])
    held = sizes.withColumn("__before", F.col("__upto") - F.col("__k")).select(*keys, "__r", "__n", "__before", F.filter(wanted, lambda w: (w["at"] >= F.col("__before")) & (w["at"] < F.col("__upto"))).alias("__want"))
    held = held.where(F.size("__want") > 0)
    right = as_right(held.withColumnRenamed("__r", "__q"), "h")
    inside = dealt.join(small(right), _all([*same("h"), F.col("__r") == F.col("__q")]))
    counts = inside.groupBy(*keys, "__r", "__n", "__before", "__want", "__v").agg(F.count(F.lit(1)).alias("__k"))
    over = Window.partitionBy(*keys, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__upto", F.col("__before") + F.sum("__k").over(over))
    counts = counts.select(*keys, "__n", "__v", F.explode("__want").alias("w"), "__upto").where(F.col("__upto") > F.col("w.at"))
    picked = counts.groupBy(*keys, "__n", "w.name").agg(F.min("__v").alias("__v"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in places], F.max("__n").alias("count"))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def nearest_place(ratio: float) -> Column:
    """The value at place ceil(n * ratio), counted from 1."""
    return F.greatest(F.lit(0), F.ceil(F.col("__n") * F.lit(float(ratio))) - 1)


def floor_place(ratio: float) -> Column:
    """The value at place int(n * ratio - 1), counted from 0, at least 0."""
    return F.greatest(F.lit(0), (F.col("__n") * F.lit(float(ratio)) - 1).cast("long"))


def upper_place() -> Column:
    """The value at place n // 2, counted from 0."""
    return F.floor(F.col("__n") / 2)


def rolling(rows: DataFrame, part: str, order: str, value: str, places: dict[str, float], most: int, per: int = scan.ROWS) -> DataFrame:
    """order, n (values) and the nearest-rank quantiles ``places`` of the last ``most`` rows of the part, this one included.

    A part is cut into pieces that carry the ``most`` - 1 rows before them; a piece keeps its frame's values in order: a row costs a search for what
    comes and for what goes, not a sort. Nulls take a place in the frame and have no value.
    """
    import pandas as pd

    names = list(places)
    pieces = scan.with_halo(rows.select(part, order, F.col(value).cast("double").alias("__value")), [part], [order], most - 1, per)

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(order)
        values, ordered, out = piece["__value"].tolist(), [], []
        for i, (x, halo, at) in enumerate(zip(values, piece["__halo"], piece[order], strict=True)):
            if i >= most and values[i - most] == values[i - most]:
                del ordered[bisect_left(ordered, values[i - most])]
            if x == x:
                insort(ordered, x)
            if not halo:
                n = len(ordered)
                out.append((at, n, *(ordered[max(0, math.ceil(n * p) - 1)] if n else None for p in places.values())))
        return pd.DataFrame(out, columns=[order, "n", *names])

    kind = rows.schema[order].dataType.simpleString()
    return pieces.groupBy(part, "__piece").applyInPandas(run, f"{order} {kind}, n int, " + ", ".join(f"{n} double" for n in names))
