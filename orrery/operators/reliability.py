"""Intraclass correlation of repeated scores, from sums of squares."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions


def squares(scores: DataFrame, subject: str, rater: str, value: str) -> DataFrame:
    """One row: subjects, raters, and the mean squares between subjects (bms), between raters (jms) and of error (ems).

    Subjects that lack a score of some rater are left out; sums are of a subject's or a rater's rows, never of pairs.
    """
    raters = scores.where(F.col(value).isNotNull()).agg(F.count_distinct(rater).alias("k"))
    full = scores.where(F.col(value).isNotNull()).groupBy(subject).agg(F.count_distinct(rater).alias("__n"))
    known = scores.join(full, subject).join(F.broadcast(raters)).where("__n = k").select(subject, rater, F.col(value).alias("__v"), "k")
    grand = known.agg(F.avg("__v").alias("g"))
    by_s = known.groupBy(subject).agg(F.avg("__v").alias("m")).join(F.broadcast(grand))
    by_r = known.groupBy(rater).agg(F.avg("__v").alias("m")).join(F.broadcast(grand))
    total = known.join(F.broadcast(grand)).agg(
        F.sum(F.pow(F.col("__v") - F.col("g"), 2)).alias("sst"), F.first("k").cast("double").alias("k")
    )
    ss = by_s.agg(F.sum(F.pow(F.col("m") - F.col("g"), 2)).alias("s"), F.count("*").cast("double").alias("n"))
    rr = by_r.agg(F.sum(F.pow(F.col("m") - F.col("g"), 2)).alias("r"))
    one = total.join(F.broadcast(ss)).join(F.broadcast(rr))
    n, k = F.col("n"), F.col("k")
    ssb, ssr = k * F.col("s"), n * F.col("r")
    return one.select(
        n.alias("n_subjects"), k.alias("n_raters"), (ssb / F.nullif(n - 1, F.lit(0))).alias("bms"),
        (ssr / F.nullif(k - 1, F.lit(0))).alias("jms"),
        ((F.col("sst") - ssb - ssr) / F.nullif((n - 1) * (k - 1), F.lit(0))).alias("ems"),
    )


def squares_by(scores: DataFrame, by: list[str], subject: str, rater: str, value: str) -> DataFrame:
    """squares of each group; a group's raters are those who scored any of its subjects. Null keys are a group."""
    known = scores.where(F.col(value).isNotNull()).select(*by, F.col(subject).alias("__subject"), F.col(rater).alias("__rater"), F.col(value).cast("double").alias("__v"))

    def same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        """Joined on equal or null names of the left side, which keeps them."""
        renamed = right.select(*[F.col(n).alias(f"__of_{n}") for n in names], *[c for c in right.columns if c not in names])
        on = reduce(and_, [F.col(n).eqNullSafe(F.col(f"__of_{n}")) for n in names])
        return left.join(renamed, on).drop(*[f"__of_{n}" for n in names])

    raters = known.groupBy(*by).agg(F.count_distinct("__rater").cast("double").alias("__k"))
    full = same(known.groupBy(*by, "__subject").agg(F.count_distinct("__rater").alias("__seen")), raters, by).where("__seen = __k").select(*by, "__subject", "__k")
    whole = same(known, full, [*by, "__subject"])
    grand = whole.groupBy(*by).agg(F.avg("__v").alias("__g"))
    off = same(whole, grand, by).withColumn("__d", F.col("__v") - F.col("__g"))
    total = off.groupBy(*by).agg(F.sum(F.col("__d") * F.col("__d")).alias("__sst"), F.first("__k").alias("__k"))
    ss = off.groupBy(*by, "__subject").agg(F.avg("__d").alias("__m")).groupBy(*by).agg(F.sum(F.col("__m") * F.col("__m")).alias("__s"), F.count("*").cast("double").alias("__n"))
    rr = off.groupBy(*by, "__rater").agg(F.avg("__d").alias("__m")).groupBy(*by).agg(F.sum(F.col("__m") * F.col("__m")).alias("__r"))
    n, k = F.col("__n"), F.col("__k")
    ssb, ssr = k * F.col("__s"), n * F.col("__r")
    return same(same(total, ss, by), rr, by).select(
        *by, n.alias("n_subjects"), k.alias("n_raters"), (ssb / F.nullif(n - 1, F.lit(0.0))).alias("bms"),
        (ssr / F.nullif(k - 1, F.lit(0.0))).alias("jms"),
        ((F.col("__sst") - ssb - ssr) / F.nullif((n - 1) * (k - 1), F.lit(0.0))).alias("ems"),
    )


def judged(rows: DataFrame, definition: str = "absolute") -> DataFrame:
    """Mean squares with icc, f_statistic, the 95 % interval (ci_lower_95, ci_upper_95), p_value, interpretation and decision.

    All are expressions of a row. Groups of one subject or one rater have no interval and no p-value; their correlation is 0
    and speaks against the scores.
    """
    n, k, f, icc = (F.col(c) for c in ("n_subjects", "n_raters", "f_statistic", "icc"))
    d2 = (n - 1) * (k - 1)
    able = (d2 > 0) & f.isNotNull() & (f < float("inf"))
    # Degrees below one give no interval; the expressions still need some.
    e1, e2 = "greatest(n_subjects - 1, 1D)", "greatest((n_subjects - 1) * (n_raters - 1), 1D)"
    grade = F.when(icc >= 0.9, "excellent").when(icc >= 0.75, "good").when(icc >= 0.5, "moderate").otherwise("poor")
    decision = F.when(icc >= 0.9, "single-run").when(icc >= 0.75, "multi-run").otherwise("reject")
    out = point(rows, definition).select(
        "*", F.when(able, f / distributions.f_quantile("0.975D", e1, e2)).alias("__low"), F.when(able, f / distributions.f_quantile("0.025D", e1, e2)).alias("__high"),
        F.when(d2 > 0, distributions.f_sf("f_statistic", e1, e2)).alias("p_value"), grade.alias("interpretation"), decision.alias("decision"),
    )
    bounds = [((F.col(c) - 1) / (F.col(c) + k - 1)).alias(name) for c, name in (("__low", "ci_lower_95"), ("__high", "ci_upper_95"))]
    return out.select("*", *bounds).drop("__low", "__high")


def point(rows: DataFrame, definition: str = "absolute") -> DataFrame:
    """icc and f_statistic of the mean squares; the absolute definition counts differences between raters as error."""
    n, k, b, j, e = (F.col(c) for c in ("n_subjects", "n_raters", "bms", "jms", "ems"))
    below = b + (k - 1) * e + (k / n * (j - e) if definition == "absolute" else F.lit(0.0))
    return rows.withColumn("icc", F.when(below > 0, (b - e) / F.nullif(below, F.lit(0.0))).otherwise(0.0)).withColumn(
        "f_statistic", F.when(e > 0, b / F.nullif(e, F.lit(0.0))).otherwise(F.lit(float("inf")))
    )


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def f_cdf(x: float, d1: float, d2: float) -> float:
    return incomplete_beta(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def f_quantile(p: float, d1: float, d2: float) -> float:
    low, high = 0.0, 1.0
    while f_cdf(high, d1, d2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f_cdf(mid, d1, d2) < p else (low, mid)
    return (low + high) / 2


def reliability(scores: DataFrame, subject: str, rater: str, value: str, definition: str = "absolute") -> dict:
    """The correlation, its 95 % interval, test, and what it says of the scores. One row comes to the driver."""
    r = point(squares(scores, subject, rater, value), definition).first()
    n, k, f = r["n_subjects"], r["n_raters"], r["f_statistic"]
    d1, d2 = n - 1, (n - 1) * (k - 1)
    low, high = f / f_quantile(0.975, d1, d2), f / f_quantile(0.025, d1, d2)
    bound = lambda x: (x - 1) / (x + k - 1) if math.isfinite(x) else math.nan
    icc = r["icc"]
    grade = "excellent" if icc >= 0.9 else "good" if icc >= 0.75 else "moderate" if icc >= 0.5 else "poor"
    decision = {"excellent": "single-run", "good": "multi-run"}.get(grade, "reject")
    p = 0.0 if math.isinf(f) else 1 - f_cdf(f, d1, d2)
    return {
        "icc": round(icc, 4), "ci_lower_95": round(bound(low), 4), "ci_upper_95": round(bound(high), 4), "n_subjects": int(n),
        "n_raters": int(k), "f_statistic": round(f, 4), "p_value": round(p, 6), "interpretation": grade, "decision": decision,
    }
