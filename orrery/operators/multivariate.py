"""Correlations of several columns in one pass, what they say of collinearity, their first component, and rank correlations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fits import independent


def _complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def moments(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, means, deviations, correlations) over the rows that have all columns: one scan, one row to the driver.

    A column that doesn't vary correlates with none: 0, and 1 with itself.
    """
    pairs = list(combinations(range(len(columns)), 2))
    c = [F.col(x).cast("double") for x in columns]
    got = _complete(rows, columns).agg(
        F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)], *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(c)],
        *[F.corr(c[i], c[j]).alias(f"r{i}_{j}") for i, j in pairs],
    ).first()
    r = np.eye(len(columns))
    for i, j in pairs:
        v = got[f"r{i}_{j}"]
        r[i, j] = r[j, i] = 0.0 if v is None or v != v else v
    return got["n"], *[np.array([got[f"{a}{i}"] or 0.0 for i in range(len(columns))]) for a in "ms"], r


def collinearity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, vif): the correlation of each ordered pair; a row of a with itself has a's variance inflation.

    Columns that others before them determine have an infinite factor, and others' factors are without them.
    """
    _, _, _, r = moments(rows, columns)
    kept = independent(r)
    inverse = np.linalg.inv(r[np.ix_(kept, kept)])
    vif = {columns[k]: float(inverse[i, i]) for i, k in enumerate(kept)}
    out = [(a, b, float(r[i, j]), vif.get(a, float("inf")) if i == j else None) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return rows.sparkSession.createDataFrame(out, "a string, b string, r double, vif double")


def first_component(rows: DataFrame, columns: list[str]) -> tuple[dict[str, float], float]:
    """(weights, explained share) of the leading component of the standardised columns; the largest weight is positive,
    of equal ones the first."""
    *_, r = moments(rows, columns)
    values, vectors = np.linalg.eigh(r)
    v = vectors[:, -1]
    top = int(np.argmax(np.round(np.abs(v), 9)))
    v = v if v[top] > 0 else -v
    return dict(zip(columns, v.tolist(), strict=True)), float(values[-1] / len(columns))


def with_component(rows: DataFrame, columns: list[str], out: str = "component") -> DataFrame:
    """rows with their value of the first component; null where a column is."""
    _, mean, deviation, _ = moments(rows, columns)
    weights, _ = first_component(rows, columns)
    terms = [F.lit(weights[c] / d) * (F.col(c) - F.lit(m)) for c, m, d in zip(columns, mean.tolist(), deviation.tolist(), strict=True) if d]
    return rows.withColumn(out, reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0))


#: Ranges that the values of a column are cut into to number them: at least so many, and one for so many different values up to a bound.
LEAST_RANGES, VALUES, MOST_RANGES = 64, 500_000, 4096


def value_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(value, rank) of the column's different values: the mean of the places that its rows take in ascending order, from 1.

    Values are counted first, so ties take one row. Cuts between ranges of values are taken once, from a sketch; counts of ranges
    tell how many rows come before each, and only within a range are values sorted. Null values have no rank.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    size = counts.count()
    ranges = min(max(LEAST_RANGES, -(-size // VALUES)), MOST_RANGES)
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(counts.agg(F.percentile_approx("value", shares, 20 * ranges)).first()[0] or []))
    # The place of a value among the sorted cuts, by halving them.
    at = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(len(cuts), 1).bit_length())),
        F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")),
        lambda s, _: F.transform(
            F.array(F.floor((s["low"] + s["high"]) / 2).cast("int")),
            lambda m: F.when(s["low"] >= s["high"], s)
            .when(F.get(F.lit(cuts), m) < F.col("value"), F.struct((m + 1).alias("low"), s["high"].alias("high")))
            .otherwise(F.struct(s["low"].alias("low"), m.alias("high"))),
        )[0],
        lambda s: s["low"],
    ) if cuts else F.lit(0)
    placed = counts.withColumn("range", at)
    sizes = placed.groupBy("range").agg(F.sum("n").alias("rows"))
    # One row for each range meets in this window.
    before = sizes.select("range", F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.join(F.broadcast(before), "range").withColumn("end", F.col("before") + F.sum("n").over(inside))
    return ended.select("value", (F.col("end") - (F.col("n") - 1) / 2).alias("rank"))


def rank_correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, rho) of each pair of columns: Spearman's correlation, ties by mean ranks, over the rows that have all of them.

    Ranks come back to rows by the different combinations of values, so a value that many rows share isn't joined for each. A
    column of one value has no correlation.
    """
    known = _complete(rows, columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    ranked = {c: value_ranks(known, c) for c in columns}
    out = None
    for a, b in combinations(columns, 2):
        pairs = known.groupBy(F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
        for c, of in (("__a", a), ("__b", b)):
            ranks = ranked[of].select(F.col("value").alias(f"{c}v"), F.col("rank").alias(f"{c}r"))
            pairs = pairs.join(ranks, F.col(c) == F.col(f"{c}v"))
        n, x, y = F.col("__n"), F.col("__ar"), F.col("__br")
        total = pairs.agg(F.sum(n).alias("n"), (F.sum(n * x) / F.sum(n)).alias("mx"), (F.sum(n * y) / F.sum(n)).alias("my"))
        off = pairs.join(F.broadcast(total.select("mx", "my")))
        dx, dy = x - F.col("mx"), y - F.col("my")
        one = off.agg(F.sum(n).alias("n"), (F.sum(n * dx * dy) / F.nullif(F.sqrt(F.sum(n * dx * dx) * F.sum(n * dy * dy)), F.lit(0.0))).alias("rho"))
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "rho")
        out = one if out is None else out.unionByName(one)
    return out
