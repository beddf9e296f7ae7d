"""Exact percentiles per group from one distributed sort, whatever a group's size.

Values are counted, the counts sorted by group and value over range partitions, and the
neighbouring order statistics found at the offsets of each partition. No task gathers a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators.ordering import ordered_table


def value_counts(df: DataFrame, groups: Sequence[str], value: Column) -> DataFrame:
    """(groups..., value, n) of the values that are finite, counted before the shuffle."""
    v = value.cast("double")
    kept = df.select(*groups, (v + F.lit(0.0)).alias("value")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return kept.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def group_percentiles(counts: DataFrame, groups: Sequence[str], probs: Sequence[float], discrete: bool = False) -> DataFrame:
    """(groups..., n, p<i>...) of ``counts`` (groups..., value, n); values may come repeatedly.

    ``p<i>`` belongs to ``probs[i]``. Interpolated: at place h = (n - 1) * p of the sorted
    values, between those at floor(h) and ceil(h). Discrete: the least value that p of all do
    not exceed. Null is a group like any other; without groups there is one row, and none for an
    empty table. A group is spread over as many sort partitions as its values need; what is
    gathered per group is one row per partition and two values per percentile.
    """
    if not groups:
        return group_percentiles(counts.select(F.lit(0).alias("_all"), "value", "n"), ["_all"], probs, discrete).drop("_all")
    line = ordered_table(counts.select(*groups, "value", "n"), [*groups, "value"], "sorted_counts")
    pieces = line.groupBy("_part", *groups).agg(F.sum("n").alias("held"))
    own = Window.partitionBy(*groups)
    so_far = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_part", *groups, "held", F.sum("held").over(own).alias("total"), F.coalesce(F.sum("held").over(so_far), F.lit(0)).alias("offset"))
    total = F.col("total").cast("double")
    place = [F.greatest(F.ceil(total * p) - 1.0, F.lit(0.0)) if discrete else (total - 1) * p for p in probs]
    targets = F.array(*[F.struct(F.lit(i).alias("i"), side.alias("side"), at.cast("long").alias("at")) for i, h in enumerate(place) for side, at in ((F.lit(0), F.floor(h)), (F.lit(1), F.ceil(h)))])
    inside = F.filter(targets, lambda t: (t["at"] >= F.col("offset")) & (t["at"] < F.col("offset") + F.col("held")))
    piece = ["_part", *groups]
    other = {c: f"_w{i}" for i, c in enumerate(piece)}
    wanted = offsets.withColumn("targets", inside).where(F.size("targets") > 0).select(*[F.col(c).alias(o) for c, o in other.items()], "total", "offset", "targets")
    # the counts of a piece in their order: the sum up to each is its range of places
    in_piece = Window.partitionBy(*piece).orderBy("value", "_row").rowsBetween(Window.unboundedPreceding, 0)
    near = line.join(wanted, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()]).drop(*other.values())
    ranged = near.withColumn("upto", F.col("offset") + F.sum("n").over(in_piece))
    hits = ranged.select(
        *groups, "total", "value",
        F.explode(F.filter("targets", lambda t: (t["at"] < F.col("upto")) & (t["at"] >= F.col("upto") - F.col("n")))).alias("t"),
    )
    found = hits.groupBy(*groups, "total").agg(
        *[F.max(F.when((F.col("t.i") == i) & (F.col("t.side") == side), F.col("value"))).alias(f"_{i}_{side}") for i in range(len(probs)) for side in (0, 1)]
    )
    out = []
    for i, h in enumerate(place):
        lo, hi = F.col(f"_{i}_0"), F.col(f"_{i}_1")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(f"p{i}"))
    return found.select(*groups, F.col("total").alias("n"), *out)
