"""Two-way fixed effects by partialling out, clustered errors, and the wild cluster bootstrap as one aggregate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def z_score(rows: DataFrame, column: str, out: str) -> DataFrame:
    """The column standardised over all rows, by a broadcast row of mean and sample deviation."""
    stats = rows.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    return rows.join(F.broadcast(stats)).withColumn(out, (F.col(column) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def balanced_within(rows: DataFrame, unit: str, period: str, columns: list[str]) -> DataFrame:
    """Columns less their unit and period means, plus the grand mean: exact for balanced panels.

    Means are aggregates joined back, so that no task gets all rows of a period.
    """
    grand = rows.agg(*[F.avg(c).alias(f"__g_{c}") for c in columns])
    out = rows
    for k, key in (("u", unit), ("p", period)):
        means = rows.groupBy(F.col(key).alias(f"__{k}")).agg(*[F.avg(c).alias(f"__{k}_{c}") for c in columns])
        out = out.join(means, F.col(key).eqNullSafe(F.col(f"__{k}")))
    out = out.join(F.broadcast(grand))
    for c in columns:
        out = out.withColumn(c, F.col(c) - F.col(f"__u_{c}") - F.col(f"__p_{c}") + F.col(f"__g_{c}"))
    return out.drop("__u", "__p", *[f"__{k}_{c}" for k in "upg" for c in columns])


#: Periods of which the equations of their effects are solved on the driver.
MOST_PERIODS = 1000


def within(rows: DataFrame, unit: str, period: str, columns: list[str]) -> DataFrame:
    """Columns less their unit and period effects, for panels with holes: exact, without iteration.

    Once units' means are taken out, the effects of the periods follow from as many equations as there are periods. Their
    sums are one aggregate over the rows of each unit, and the driver solves them; more than MOST_PERIODS are an error.
    Null units and periods are a unit and a period.
    """
    spark = rows.sparkSession
    periods = [r[0] for r in rows.select(period).distinct().limit(MOST_PERIODS + 1).collect()]
    if len(periods) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    place = {p: k for k, p in enumerate(periods)}
    own = Window.partitionBy(unit)
    flat = rows.select("*", *[(F.col(c) - F.avg(c).over(own)).alias(f"__d_{c}") for c in columns])
    totals = flat.groupBy(period).agg(F.count("*").alias("n"), *[F.sum(f"__d_{c}").alias(c) for c in columns]).collect()
    # For each pair of periods, the sum over units of the rows in both by the rows of the unit.
    per_unit = rows.groupBy(unit, period).agg(F.count("*").alias("n")).groupBy(unit).agg(F.collect_list(F.struct(F.col(period).alias("t"), "n")).alias("ts"), F.sum("n").alias("size"))
    pairs = per_unit.select("size", F.explode("ts").alias("a"), "ts").select("size", "a", F.explode("ts").alias("b"))
    shared = pairs.groupBy(F.col("a.t").alias("t"), F.col("b.t").alias("o")).agg(F.sum(F.col("a.n") * F.col("b.n") / F.col("size")).alias("w")).collect()
    left, right = np.zeros((len(periods), len(periods))), np.zeros((len(periods), len(columns)))
    for r in totals:
        left[place[r[period]], place[r[period]]] += r["n"]
        right[place[r[period]]] = [r[c] or 0.0 for c in columns]
    for r in shared:
        left[place[r["t"]], place[r["o"]]] -= r["w"]
    effects = np.linalg.lstsq(left, right, rcond=None)[0]
    found = [(p, *map(float, effects[k])) for p, k in place.items()]
    schema = f"__t {rows.schema[period].dataType.simpleString()}, " + ", ".join(f"__e_{c} double" for c in columns)
    joined = flat.join(F.broadcast(spark.createDataFrame(found, schema)), F.col(period).eqNullSafe(F.col("__t")))
    return joined.select(
        *[F.col(c) for c in rows.columns if c not in columns],
        *[(F.col(f"__d_{c}") - F.col(f"__e_{c}") + F.avg(f"__e_{c}").over(own)).alias(c) for c in columns],
    )


def slope(residual: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """One row: beta of residualised y on x."""
    return residual.agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(x) * F.col(x)), F.lit(0.0))).alias("beta"))


def cluster_scores(residual: DataFrame, cluster: str, y: str = "y", x: str = "x") -> DataFrame:
    """(cluster, score, xx): sums of x times the residual, and of x squared."""
    beta = slope(residual, y, x)
    e = F.col(y) - F.col("beta") * F.col(x)
    return residual.join(F.broadcast(beta)).groupBy(cluster).agg(F.sum(F.col(x) * e).alias("score"), F.sum(F.col(x) * F.col(x)).alias("xx"))


def clustered_fit(residual: DataFrame, cluster: str, period: str, y: str = "y", x: str = "x") -> DataFrame:
    """beta and its clustered error: the sandwich times G / (G - 1) * (N - 1) / (N - K), with K the periods and x.

    Effects of the clusters themselves are nested in them and not counted.
    """
    sums = cluster_scores(residual, cluster, y, x).agg(
        F.sum(F.pow("score", F.lit(2))).alias("meat"), F.sum("xx").alias("bread"), F.count("*").alias("g")
    )
    size = residual.agg(F.count("*").alias("n"), F.count_distinct(period).alias("t"))
    one = slope(residual, y, x).join(F.broadcast(sums)).join(F.broadcast(size))
    scale = F.col("g") / (F.col("g") - 1) * (F.col("n") - 1) / (F.col("n") - F.col("t") - 1)
    return one.select("beta", (F.sqrt(F.col("meat") * scale) / F.col("bread")).alias("se"), F.col("g").alias("n_clusters"), F.col("n").alias("n_obs"))


def rademacher(cluster: Column, draw: Column) -> Column:
    """1 or -1 from a hash of cluster and draw."""
    first = F.substring(F.md5(F.concat_ws("-", cluster.cast("string"), draw.cast("string"))), 1, 1)
    return F.when(first < "8", 1).otherwise(-1)


def wild_bootstrap(scores: DataFrame, cluster: str, draws: int = 999) -> DataFrame:
    """(draw, b): with the null imposed, a draw's coefficient is the signed sum of cluster scores over the sum of x squared.

    Clusters times draws are generated, never rows times draws; each task sums its clusters before the shuffle.
    """
    each = scores.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sums = each.groupBy("draw").agg(F.sum(rademacher(F.col(cluster), F.col("draw")) * F.col("score")).alias("s"))
    total = scores.agg(F.sum("xx").alias("xx"))
    return sums.join(F.broadcast(total)).select("draw", (F.col("s") / F.col("xx")).alias("b"))


def bootstrap_p(scores: DataFrame, beta: DataFrame, cluster: str, draws: int = 999) -> DataFrame:
    b = wild_bootstrap(scores, cluster, draws).join(F.broadcast(beta))
    return b.agg(F.avg((F.abs("b") >= F.abs("beta")).cast("double")).alias("p"))


def two_slopes(residual: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """One row: the coefficients of two residualised regressors."""
    def s(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b))

    det = s(x1, x1) * s(x2, x2) - s(x1, x2) * s(x1, x2)
    return residual.agg(
        ((s(x1, y) * s(x2, x2) - s(x2, y) * s(x1, x2)) / det).alias("beta_early"),
        ((s(x2, y) * s(x1, x1) - s(x1, y) * s(x1, x2)) / det).alias("beta_advanced"),
    )


# Fixed values.
MIN_CLUSTERS, MIN_REVENUE = 10, 5
OUTCOMES = ("ln_revenue", "gross_margin", "operating_margin", "rd_intensity", "sga_intensity")


def sample(panel: DataFrame, flag: str | None) -> DataFrame:
    """Rows of a size class with enough revenue before the shock; without a class all rows, whatever their revenue."""
    return panel if flag is None else panel.where((F.col(flag) == 1) & (F.col("pre_rev_m") >= MIN_REVENUE))


def did(panel: DataFrame, score: str, outcome: str = "ln_revenue", unit: str = "ticker", period: str = "year_quarter", draws: int = 999) -> DataFrame:
    """beta, se, p, n_clusters and n_obs of post times the standardised score; no row for too few units."""
    return mechanisms(panel, score, (outcome,), unit=unit, period=period, draws=draws).drop("outcome")


def mechanisms(
    panel: DataFrame, score: str, outcomes: tuple[str, ...] = OUTCOMES, unit: str = "ticker", period: str = "year_quarter", draws: int = 999
) -> DataFrame:
    """A fit for each outcome that the panel has, all of them at once."""
    from .fits import Fit, Term, estimate

    asked = [Fit(name, name, (Term("x", (score,), "post"),)) for name in outcomes if name in panel.columns]
    found = estimate(panel, asked, unit, period, draws, min_clusters=MIN_CLUSTERS).coefficients.where("not dropped")
    return found.select("beta", "se", "n_clusters", "n_obs", "p", F.col("fit").alias("outcome"))


def three_period(
    panel: DataFrame, score: str, early: str, advanced: str, outcome: str = "ln_revenue", unit: str = "ticker", period: str = "year_quarter", draws: int = 999
) -> DataFrame:
    """(term, beta, se, p): both periods' coefficients of one fit, each with the bootstrap's p-value of a fit of its own.

    ``early`` and ``advanced`` are columns that are 1 in their periods.
    """
    from .fits import Fit, Term, estimate

    a, b = Term("early", (score,), early), Term("advanced", (score,), advanced)
    found = estimate(panel, [Fit("both", outcome, (a, b)), Fit("early", outcome, (a,)), Fit("advanced", outcome, (b,))], unit, period, draws).coefficients
    alone = found.where("fit <> 'both'").select("term", "p")
    return found.where("fit = 'both'").select("term", "beta", "se").join(F.broadcast(alone), "term")
