"""Many fixed-effects regressions on one panel at once, with holes, several regressors, clustered errors and a wild bootstrap.

A fit is a sample, an outcome and terms; a term is a product of standardised scores and a column of the panel, such as one that
is 1 after a shock. All fits share their passes over the panel, so the number of jobs doesn't depend on the number of fits:

1. one row of means and deviations of all fits' scores;
2. cells: of each (fit, unit, period) the number of rows, sums and cross products, added up before the shuffle;
3. with W the units' sums by period and of the variables, and D the inverse of their sizes, the cross products of period dummies
   and variables, less their units' means, are M - W'DW. Tasks make it for blocks of units, its entries are added up,
   and a task for each fit takes the period effects out of it by a Schur complement. So holes are exact, without iteration;
4. a Cholesky factor with pivots tells which terms depend on earlier ones; those are dropped and reported;
5. of each unit the scores, x times the residual, from its cells; from these the sandwich and the bootstrap, whose signs are
   drawn once for each unit and multiplied with the scores of all fits.

Units are the clusters. Periods are at most MOST_PERIODS, as a fit's equations have their number of unknowns; what comes to the
driver is bounded by fits, periods and terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .reliability import f_cdf

MOST_PERIODS = 4000
#: Units that a task's block of the equations takes, and the share of a term's variance that must be its own.
UNITS, OWN = 2000, 1e-9


class Term(NamedTuple):
    name: str
    scores: tuple[str, ...]
    when: str


class Fit(NamedTuple):
    name: str
    outcome: str
    terms: tuple[Term, ...]
    where: Column | None = None


class Estimates(NamedTuple):
    """coefficients: (fit, term, beta, se, p, n_clusters, n_obs, dropped), with p of the bootstrap, or null without draws;
    joint: (fit, terms, f, p, n_terms) of the Wald tests that were asked for."""

    coefficients: DataFrame
    joint: DataFrame


def _in_sample(fit: Fit) -> Column:
    known = [F.col(fit.outcome).isNotNull(), *[F.col(s).isNotNull() for t in fit.terms for s in t.scores]]
    return F.coalesce(reduce(and_, known, F.lit(True) if fit.where is None else fit.where), F.lit(False))


def _design(panel: DataFrame, fits: list[Fit], unit: str, period: str) -> tuple[DataFrame, int]:
    """((fit, unit, period, v0 .. vK), K): the terms of each fit, zeros beyond its own, and its outcome as the last one."""
    wide = max(len(f.terms) for f in fits)
    asked = [(k, s) for k, f in enumerate(fits) for s in sorted({s for t in f.terms for s in t.scores})]
    aggs = [g(F.when(_in_sample(fits[k]), F.col(s))) for k, s in asked for g in (F.avg, F.stddev_samp)]
    got = panel.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first() if aggs else []
    moments = {key: (got[2 * i], got[2 * i + 1]) for i, key in enumerate(asked)}

    def value(k: int, t: Term) -> Column:
        out = F.col(t.when).cast("double")
        for s in t.scores:
            mean, deviation = moments[k, s]
            out = out * ((F.col(s) - F.lit(mean)) / F.lit(deviation or None))
        return F.coalesce(out, F.lit(0.0))

    rows = []
    for k, f in enumerate(fits):
        values = [value(k, t) for t in f.terms] + [F.lit(0.0)] * (wide - len(f.terms)) + [F.col(f.outcome).cast("double")]
        one = F.struct(F.lit(k).alias("fit"), *[v.alias(f"v{j}") for j, v in enumerate(values)])
        rows.append(F.when(_in_sample(f), one))
    each = F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull()))
    return panel.select(F.col(unit).alias("unit"), F.col(period).alias("period"), each.alias("r")).select("unit", "period", "r.*"), wide


def _cells(rows: DataFrame, wide: int) -> DataFrame:
    """(fit, unit, period, n, s0 .. sK, q) with q the upper triangle of cross products."""
    v = [F.col(f"v{j}") for j in range(wide + 1)]
    products = [F.sum(v[i] * v[j]) for i in range(wide + 1) for j in range(i, wide + 1)]
    per = rows.groupBy("fit", "unit", "period").agg(
        F.count("*").cast("double").alias("n"), F.array(*[F.sum(x) for x in v]).alias("s"), F.array(*products).alias("q")
    )
    return per.repartition("fit", "unit").sortWithinPartitions("fit", "unit")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """(numbers, values): each row's number among the column's different values, nulls being one of them."""
    coded = column.combine_chunks().dictionary_encode("encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


class _Block:
    """The cells of whole units of one fit."""

    def __init__(self, table: pa.Table, place: dict, wide: int):
        n = table.num_rows
        self.n = table.column("n").to_numpy()
        self.s = np.array(table.column("s").combine_chunks().flatten()).reshape(n, wide + 1)
        upper = np.array(table.column("q").combine_chunks().flatten()).reshape(n, -1)
        self.q = np.empty((n, wide + 1, wide + 1))
        i, j = np.triu_indices(wide + 1)
        self.q[:, i, j] = self.q[:, j, i] = upper
        at, found = _codes(table.column("period"))
        self.t = np.array([place[p] for p in found])[at]
        new = np.r_[True, np.diff(_codes(table.column("unit"))[0]) != 0]
        self.heads = np.flatnonzero(new)
        self.unit = np.cumsum(new) - 1
        self.names = table.column("unit").take(pa.array(self.heads)).to_pylist()
        self.size = np.add.reduceat(self.n, self.heads)
        self.sums = np.add.reduceat(self.s, self.heads)


def _blocks(batches: Iterator[pa.RecordBatch], place: dict, wide: int) -> Iterator[tuple[int, _Block]]:
    """Blocks of up to some UNITS units of a fit, from cells that are sorted by fit and unit; units are not cut."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool) -> tuple[list, pa.Table]:
        fits = table.column("fit").to_numpy()
        other = np.diff(fits) != 0
        starts = np.r_[0, np.flatnonzero(other | (np.diff(_codes(table.column("unit"))[0]) != 0)) + 1]
        # Units of a fit in order; a block begins with a fit, and every UNITS units. The last unit may go on.
        first = np.r_[True, fits[starts[1:]] != fits[starts[1:] - 1]]
        place_in_fit = np.arange(len(starts)) - np.maximum.accumulate(np.where(first, np.arange(len(starts)), 0))
        ends = len(fits) if last else int(starts[-1])
        heads = [*starts[(place_in_fit % UNITS == 0) & (starts < ends)].tolist(), ends]
        out = [(int(fits[s]), _Block(table.slice(s, e - s), place, wide)) for s, e in zip(heads, heads[1:], strict=False)]
        return out, table.slice(ends)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) > 20 * UNITS:
            out, rest = cut(pa.Table.from_batches(held), False)
            yield from out
            held = rest.to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held), True)[0]


def _equations(cells: DataFrame, periods: list, wide: int) -> DataFrame:
    """(fit, i, j, v): cross products, upper triangle and squares beside it, of the periods' dummies and the variables, less their units' means."""
    place = {p: k for k, p in enumerate(periods)}
    t = len(periods)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for fit, b in _blocks(batches, place, wide):
            w = np.zeros((len(b.heads), t + wide + 1))
            np.add.at(w, (b.unit, b.t), b.n)
            w[:, t:] = b.sums
            m = -(w.T @ (w / b.size[:, None]))
            np.add.at(m, (b.t, b.t), b.n)
            by_period = np.zeros((t, wide + 1))
            np.add.at(by_period, b.t, b.s)
            m[:t, t:] += by_period
            m[t:, t:] += b.q.sum(0)
            # Beside them, the variables' sums of squares as they came.
            m = np.column_stack([m, np.r_[np.zeros(t), np.einsum("nii->i", b.q)]])
            sums[fit] = sums[fit] + m if fit in sums else m
        for fit, m in sums.items():
            i, j = np.triu_indices(len(m), m=len(m) + 1)
            some = m[i, j] != 0
            i, j = i[some], j[some]
            kinds = [np.full(len(i), fit, np.int32), i.astype(np.int32), j.astype(np.int32), m[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kinds], names=["fit", "i", "j", "v"])

    return cells.mapInArrow(run, "fit int, i int, j int, v double").groupBy("fit", "i", "j").agg(F.sum("v").alias("v"))


def independent(gram: np.ndarray, own: float = OWN) -> list[int]:
    """Columns, from the first on, that don't depend on those before: a Cholesky factor whose pivots are tested for their own share."""
    left, kept = gram.astype(float).copy(), []
    for k in range(len(gram)):
        if gram[k, k] > 0 and left[k, k] > own * gram[k, k]:
            kept.append(k)
            left = left - np.outer(left[:, k], left[k]) / left[k, k]
    return kept


def _solver(periods: int, wide: int):
    def solve(table: pa.Table) -> pa.Table:
        size = periods + wide + 1
        g = np.zeros((size, size + 1))
        g[table.column("i").to_numpy(), table.column("j").to_numpy()] = table.column("v").to_numpy()
        g, plain = np.triu(g[:, :-1]) + np.triu(g[:, :-1], 1).T, g[periods:-1, -1]
        effects = np.linalg.pinv(g[:periods, :periods], hermitian=True) @ g[:periods, periods:]
        rest = g[periods:, periods:] - g[periods:, :periods] @ effects
        # What the fixed effects explain whole is no regressor, though rounding leaves a little of it.
        kept = [k for k in independent(rest[:-1, :-1]) if rest[k, k] > OWN * plain[k]]
        inverse = np.zeros((wide, wide))
        if kept:
            inverse[np.ix_(kept, kept)] = np.linalg.inv(rest[np.ix_(kept, kept)])
        beta = inverse @ rest[:-1, -1]
        return pa.table(
            {
                "fit": table.column("fit").slice(0, 1), "effects": pa.array([effects.tobytes()], pa.binary()), "beta": [beta.tolist()],
                "inverse": pa.array([inverse.tobytes()], pa.binary()), "kept": pa.array([kept], pa.list_(pa.int32())),
            }
        )

    return solve


def _unit_scores(cells: DataFrame, periods: list, wide: int, solved: dict, kind: str) -> DataFrame:
    """(fit, unit, score, n): of each unit the sum of x times the residual, all effects taken out."""
    place = {p: k for k, p in enumerate(periods)}
    table_kind = to_arrow_type(cells.schema["unit"].dataType)
    sent = cells.sparkSession.sparkContext.broadcast({k: (e, b) for k, (e, b, *_) in solved.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for fit, b in _blocks(batches, place, wide):
            effects, beta = found[fit]
            mine = effects[b.t]
            mean = np.add.reduceat(mine * b.n[:, None], b.heads) / b.size[:, None]
            # What is taken from each variable in a cell: its unit's mean and its period's effect, centred in the unit.
            c = (b.sums / b.size[:, None] - mean)[b.unit] + mine
            sc = b.s[:, :, None] * c[:, None, :]
            r = b.q - sc - sc.transpose(0, 2, 1) + b.n[:, None, None] * c[:, :, None] * c[:, None, :]
            r = np.add.reduceat(r, b.heads)
            score = r[:, :-1, -1] - r[:, :-1, :-1] @ beta
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(b.heads), fit, np.int32)), pa.array(b.names, table_kind),
                    pa.array(score.tolist(), pa.list_(pa.float64())), pa.array(b.size),
                ],
                names=["fit", "unit", "score", "n"],
            )

    return cells.mapInArrow(run, f"fit int, unit {kind}, score array<double>, n double")


def _bootstrap(scores: DataFrame, draws: int, wide: int) -> DataFrame:
    """(fit, draw, s0 ..): sums of the scores with the units' signs; a unit's signs are drawn once for all fits."""
    from .regression import rademacher

    per = scores.groupBy("unit").agg(F.collect_list(F.struct("fit", "score")).alias("fits"))
    signs = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: rademacher(F.col("unit"), d))
    rows = per.select(signs.cast("array<tinyint>").alias("signs"), "fits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            signs = np.array(b.column("signs").flatten()).reshape(b.num_rows, draws).astype(float)
            by: dict[int, tuple[list, list]] = {}
            for i, fits in enumerate(b.column("fits").to_pylist()):
                for f in fits:
                    at, some = by.setdefault(f["fit"], ([], []))
                    at.append(i)
                    some.append(f["score"])
            for fit, (at, some) in by.items():
                s = signs[at].T @ np.array(some)
                sums[fit] = sums[fit] + s if fit in sums else s
        for fit, s in sums.items():
            columns = [pa.array(np.full(draws, fit, np.int32)), pa.array(np.arange(1, draws + 1, dtype=np.int32)), *[pa.array(s[:, j]) for j in range(wide)]]
            yield pa.RecordBatch.from_arrays(columns, names=["fit", "draw", *[f"s{j}" for j in range(wide)]])

    found = rows.mapInArrow(run, "fit int, draw int, " + ", ".join(f"s{j} double" for j in range(wide)))
    return found.groupBy("fit", "draw").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(wide)])


def estimate(
    panel: DataFrame, fits: list[Fit], unit: str, period: str, draws: int = 999, joint: dict[str, tuple[str, ...]] | None = None, min_clusters: int = 10
) -> Estimates:
    """Estimates of all fits, but for those of fewer than ``min_clusters`` units. ``joint`` names terms of fits that are tested together.

    Rows without the outcome or a score, or outside of the sample, are left out; null units and periods are a unit and a period.
    A panel may have several rows of a unit in a period. Errors are clustered by unit, times G / (G - 1) * (N - 1) / (N - K), with K
    the periods and the terms kept; effects of the clusters themselves aren't counted. The bootstrap imposes the null on one
    term at a time: the signs go with the residuals of the whole fit.
    """
    spark = panel.sparkSession
    rows, wide = _design(panel, fits, unit, period)
    cells = _cells(rows, wide).persist()
    try:
        periods = [r[0] for r in cells.select("period").distinct().limit(MOST_PERIODS + 1).collect()]
        if len(periods) > MOST_PERIODS:
            raise ValueError(f"more than {MOST_PERIODS} periods")
        found = _equations(cells, periods, wide).groupBy("fit").applyInArrow(
            _solver(len(periods), wide), "fit int, effects binary, beta array<double>, inverse binary, kept array<int>"
        )
        solved = {
            r["fit"]: (np.frombuffer(r["effects"]).reshape(-1, wide + 1), np.array(r["beta"]), np.frombuffer(r["inverse"]).reshape(wide, wide), r["kept"])
            for r in found.collect()
        }
        scores = _unit_scores(cells, periods, wide, solved, cells.schema["unit"].dataType.simpleString()).persist()
        s = [F.col("score")[j] for j in range(wide)]
        used = cells.groupBy("fit").agg(F.count_distinct(F.coalesce(F.col("period").cast("string"), F.lit("\0"))).alias("t"))
        meat = scores.groupBy("fit").agg(
            F.count("*").alias("g"), F.sum("n").alias("n"), *[F.sum(s[i] * s[j]).alias(f"m{i}_{j}") for i in range(wide) for j in range(i, wide)]
        )
        meats = {r["fit"]: r for r in meat.join(used, "fit").collect()}
        p_values: dict[int, list] = {}
        if draws and solved:
            b = _bootstrap(scores, draws, wide)
            known = spark.createDataFrame([(k, inv.tolist(), beta.tolist()) for k, (_, beta, inv, _) in solved.items()], "fit int, inv array<array<double>>, beta array<double>")
            drawn = [reduce(lambda x, y: x + y, [F.col("inv")[i][j] * F.col(f"s{j}") for j in range(wide)]) for i in range(wide)]
            p = [F.avg((F.abs(d) >= F.abs(F.col("beta")[i])).cast("double")).alias(f"p{i}") for i, d in enumerate(drawn)]
            p_values = {r["fit"]: [r[f"p{i}"] for i in range(wide)] for r in b.join(F.broadcast(known), "fit").groupBy("fit").agg(*p).collect()}
        scores.unpersist()
    finally:
        cells.unpersist()
    out, tests = [], []
    for k, f in enumerate(fits):
        if k not in solved or meats[k]["g"] < min_clusters:
            continue
        _, beta, inverse, kept = solved[k]
        r, m = meats[k], np.zeros((wide, wide))
        for i in range(wide):
            for j in range(i, wide):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        g, n = r["g"], r["n"]
        free = n - r["t"] - len(kept)
        cov = inverse @ m @ inverse * (g / (g - 1) * (n - 1) / free if free > 0 and g > 1 else np.nan)
        for i, t in enumerate(f.terms):
            lost = i not in kept
            numbers = (None, None, None) if lost else (float(beta[i]), float(np.sqrt(cov[i, i])), p_values[k][i] if k in p_values else None)
            out.append((f.name, t.name, *numbers, int(g), int(n), lost))
        names = [t.name for t in f.terms]
        at = [names.index(x) for x in (joint or {}).get(f.name, ()) if names.index(x) in kept]
        if at:
            wald = float(beta[at] @ np.linalg.pinv(cov[np.ix_(at, at)], hermitian=True) @ beta[at]) / len(at)
            tests.append((f.name, ",".join(names[i] for i in at), wald, 1 - f_cdf(wald, len(at), g - 1), len(at)))
    return Estimates(
        spark.createDataFrame(out, "fit string, term string, beta double, se double, p double, n_clusters long, n_obs long, dropped boolean"),
        spark.createDataFrame(tests, "fit string, terms string, f double, p double, n_terms int"),
    )
