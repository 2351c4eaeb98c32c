"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Every step is an aggregation and a join over edges; neither edges nor labels ever come to the driver. A node with very
many neighbours is one row of the aggregate, and the join back is a sort-merge join whose skewed side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the least node of its component.

    Edges may repeat and have either direction; those with a null end are left out. No edges give no rows.
    """
    found = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    found = materialize(_small_star(found), "edges")
    before = None
    while (now := _mark(found)) != before and now[0]:
        before = now
        found = materialize(_small_star(_large_star(found)), "edges")
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


