"""Exact percentiles of groups of any size, without the values of a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of values that a group is cut into; the ranks wanted are looked for within one or two of them.
RANGES = 128


def ordered(rows: DataFrame, group: str, value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(g, n, m): of each group its number of values, and a map from 0, 1, .. to the values at the ranks, which count from 0.

    ``ranks`` makes them from n. Different values are counted first, so ties take one row. A sketch of bounded size gives each
    group its cuts; counts over the ranges between them tell where a rank is, and only those ranges are sorted. Null values don't
    count, and a group without others has no row; a null group is a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    cuts = counts.groupBy(F.col("g").alias("cg")).agg(F.percentile_approx("v", steps, 20 * RANGES).alias("cuts"))
    placed = counts.join(cuts, F.col("g").eqNullSafe(F.col("cg"))).select("g", "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("bin"))
    # A row for each group and range from here on.
    sizes = placed.groupBy("g", "bin").agg(F.sum("c").alias("size"))
    up_to = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("before", F.coalesce(F.sum("size").over(up_to), F.lit(0))).withColumn("n", F.sum("size").over(Window.partitionBy("g")))
    ranked = ranked.withColumn("ranks", F.array(*ranks(F.col("n")))).where(
        F.exists("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))
    ).select(F.col("g").alias("rg"), F.col("bin").alias("rb"), "before", "n", "ranks")
    inside = Window.partitionBy("g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(ranked, F.col("g").eqNullSafe(F.col("rg")) & (F.col("bin") == F.col("rb"))).withColumn(
        "end", F.col("before") + F.sum("c").over(inside)
    )
    found = near.select("g", "n", "v", F.posexplode("ranks").alias("k", "r"), (F.col("end") - F.col("c")).alias("start"), "end")
    found = found.where((F.col("r") >= F.col("start")) & (F.col("r") < F.col("end")))
    return found.groupBy("g").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))


def exact_percentiles(rows: DataFrame, group: str, value: str, shares: list[float], out: str = "percentiles") -> DataFrame:
    """(group, out): an array with the percentile of each share, linearly interpolated between neighbours in rank."""
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    ends = ordered(rows, group, value, lambda _: [x for a in at for x in (F.floor(a), F.ceil(a))])

    def between(k: int, a):
        low, high = F.col("m")[F.lit(2 * k)], F.col("m")[F.lit(2 * k + 1)]
        return F.when(F.floor(a) == F.ceil(a), low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high)

    return ends.select(F.col("g").alias(group), F.array(*[between(k, a) for k, a in enumerate(at)]).alias(out))
