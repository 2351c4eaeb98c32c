"""Means of firms that stand up to outliers and to few rows: trimmed by exact ranks, and drawn to the common mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import ordered


def trimmed_means(rows: DataFrame, key: str, value: str, trim: float = 0.1) -> DataFrame:
    """(key, n, trimmed): the mean of a key's values but for its floor(trim * n) least and as many greatest.

    Exact for keys of any size: the values at the two ends are found by ranges (``quantiles.ordered``), and what is left is a sum of
    what lies between them and of as many copies of the ends as are in. Null values don't count; a null key is a key.
    """
    cut = lambda n: F.floor(F.lit(trim) * n + 1e-9)
    ends = ordered(rows, key, value, lambda n: [cut(n), n - 1 - cut(n)]).select(
        F.col("g").alias("__g"), F.col("n").alias("__n"), F.col("m")[F.lit(0)].alias("__low"), F.col("m")[F.lit(1)].alias("__high")
    )
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    v, c, low, high = (F.col(x) for x in ("v", "c", "__low", "__high"))
    part = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
    sums = counts.join(ends, F.col("g").eqNullSafe(F.col("__g"))).groupBy("g").agg(
        F.max("__n").alias("n"), F.max("__low").alias("low"), F.max("__high").alias("high"),
        part((v > low) & (v < high), v * c).alias("inner"), part(v <= low, c).alias("at_low"), part(v >= high, c).alias("at_high"),
    )
    k = cut(F.col("n"))
    kept = F.col("inner") + F.col("low") * (F.col("at_low") - k) + F.col("high") * (F.col("at_high") - k)
    mean = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(kept / (F.col("n") - 2 * k))
    return sums.select(F.col("g").alias(key), "n", mean.alias("trimmed"))


def variance_components(per: DataFrame) -> DataFrame:
    """One row from keys' (n, mean, ss): within, between (not below 0) and the common mean that shrunk means are drawn to.

    ss are sums of squares about a key's mean. Components are those of one-way analysis of variance for unequal sizes.
    """
    n, m = F.col("n"), F.col("mean")
    total = per.agg(F.sum("n").alias("N"), F.count("*").alias("G"), (F.sum(n * m) / F.sum("n")).alias("grand"), F.sum("ss").alias("ssw"), F.sum(n * n).alias("nn"))
    around = per.join(F.broadcast(total.select("grand"))).agg(F.sum(n * F.pow(m - F.col("grand"), F.lit(2))).alias("ssb"))
    one = total.join(F.broadcast(around))
    within = F.col("ssw") / F.nullif(F.col("N") - F.col("G"), F.lit(0))
    size = (F.col("N") - F.col("nn") / F.col("N")) / F.nullif(F.col("G") - 1, F.lit(0))
    one = one.select("grand", within.alias("within"), (F.col("ssb") / F.nullif(F.col("G") - 1, F.lit(0))).alias("msb"), size.alias("size"))
    between = F.greatest(F.coalesce((F.col("msb") - F.col("within")) / F.nullif(F.col("size"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return one.select("grand", "within", between.alias("between"))


def weight_of(n: Column) -> Column:
    """How much of a key's own mean counts: 1 where rows of a key don't differ, 0 where keys don't."""
    spread = F.col("between") + F.coalesce(F.col("within"), F.lit(0.0)) / n
    return F.coalesce(F.col("between") / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def shrunk_means(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, weight, shrunk): empirical Bayes means, between a key's own and the mean of all keys by their weights.

    A null key is a key; null values don't count. Where no key has two rows, means can't be told from chance and are drawn whole.
    """
    known = rows.where(F.col(value).isNotNull())
    per = known.groupBy(F.col(key).alias("g")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_pop(value) * F.count("*"), F.lit(0.0)).alias("ss")
    )
    weighed = per.join(F.broadcast(variance_components(per))).withColumn("weight", F.when(F.col("within").isNull(), 0.0).otherwise(weight_of(F.col("n"))))
    common = weighed.agg((F.sum(F.col("weight") * F.col("mean")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("common"))
    shrunk = F.col("weight") * F.col("mean") + (1 - F.col("weight")) * F.coalesce("common", "grand")
    return weighed.join(F.broadcast(common)).select(F.col("g").alias(key), "n", "mean", "weight", shrunk.alias("shrunk"))
