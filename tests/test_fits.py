import hashlib
import random

import numpy as np
import pytest
from orrery.operators import fits
from orrery.operators.fits import Fit, Term
from pyspark.sql import functions as F

COLUMNS = "unit string, period int, y double, o double, rho double, delta double, post int, late int, small boolean"


def panel(rng, units=60, periods=9):
    out = []
    for u in range(units):
        rho, delta = rng.random(), rng.random() if u % 9 else None
        for t in range(periods):
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                y = 3 + u % 7 + 0.3 * t + (t >= 5) * (0.7 * rho - 0.2 * (delta or 0)) + rng.gauss(0, 0.3)
                out.append((f"u{u}" if u else None, t, y, rng.random() if rng.random() < 0.8 else None, rho, delta, int(t >= 5), int(t >= 7), u % 3 == 0))
    return out


def least_squares(rows, terms, outcome):
    """Coefficients, errors and unit scores by dummies."""
    y = np.array([r[outcome] for r in rows], float)
    scores = {s for t in terms for s in t.scores}
    z = {}
    for s in scores:
        v = np.array([r[s] for r in rows])
        z[s] = (v - v.mean()) / v.std(ddof=1)
    x = np.array([np.prod([z[s] for s in t.scores], axis=0) * np.array([r[t.when] for r in rows], float) for t in terms]).T
    units, periods = sorted({str(r["unit"]) for r in rows}), sorted({r["period"] for r in rows})
    d = np.array([[str(r["unit"]) == u for u in units] + [r["period"] == p for p in periods] for r in rows], float)
    clean = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    x, y = clean(x), clean(y)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    sc = np.array([(x * e[:, None])[[str(r["unit"]) == u for r in rows]].sum(0) for u in units])
    inv = np.linalg.pinv(x.T @ x)
    g, n, k = len(units), len(rows), len(periods) + len(terms)
    cov = inv @ (sc.T @ sc) @ inv * g / (g - 1) * (n - 1) / (n - k)
    return beta, np.sqrt(np.diag(cov)), dict(zip(units, sc, strict=True)), inv, cov


@pytest.fixture(scope="module")
def rows():
    return panel(random.Random(8))


def test_all_fits_are_those_of_dummies(spark, rows, monkeypatch):
    monkeypatch.setattr(fits, "UNITS", 7)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    a, b, c = Term("rho", ("rho",), "post"), Term("delta", ("delta",), "post"), Term("both", ("rho", "delta"), "post")
    asked = [
        Fit("one", "y", (a,)), Fit("o", "o", (a,)), Fit("small", "y", (a,), F.col("small")), Fit("triple", "y", (a, b, c)),
        Fit("periods", "y", (a, Term("late", ("rho",), "late"))), Fit("few", "y", (a,), F.col("unit").isin("u1", "u2")),
        Fit("twice", "y", (a, Term("again", ("rho",), "post"), b)), Fit("none", "y", (a,), F.lit(False)),
    ]
    got = fits.estimate(df, asked, "unit", "period", draws=199, joint={"triple": ("delta", "both"), "one": ("rho",)})
    by = {(r["fit"], r["term"]): r for r in got.coefficients.collect()}
    assert {k[0] for k in by} == {"one", "o", "small", "triple", "periods", "twice"}
    names = [f.split()[0] for f in COLUMNS.split(", ")]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    for f in asked:
        if f.name in ("few", "none", "twice"):
            continue
        mine = [r for r in dicts if r[f.outcome] is not None and all(r[s] is not None for t in f.terms for s in t.scores) and (f.name != "small" or r["small"])]
        beta, se, scores, inv, cov = least_squares(mine, f.terms, f.outcome)
        sign = {u: np.array([1 if hashlib.md5(f"{u}-{d}".replace("None-", "").encode()).hexdigest()[0] < "8" else -1 for d in range(1, 200)]) for u in scores}
        drawn = inv @ sum(np.outer(scores[u], sign[u]) for u in scores)
        for i, t in enumerate(f.terms):
            r = by[f.name, t.name]
            assert r["beta"] == pytest.approx(beta[i], abs=1e-8) and r["se"] == pytest.approx(se[i], abs=1e-8)
            assert (r["n_clusters"], r["n_obs"], r["dropped"]) == (len(scores), len(mine), False)
            assert r["p"] == pytest.approx(np.mean(np.abs(drawn[i]) >= abs(beta[i])), abs=1e-9)
        if f.name == "triple":
            w = beta[1:] @ np.linalg.inv(cov[1:, 1:]) @ beta[1:] / 2
            j = {r["fit"]: r for r in got.joint.collect()}
            assert j["triple"]["f"] == pytest.approx(w, rel=1e-6) and j["triple"]["n_terms"] == 2 and 0 < j["triple"]["p"] < 1
            assert j["one"]["f"] == pytest.approx((by["one", "rho"]["beta"] / by["one", "rho"]["se"]) ** 2)
    # A term that repeats another one goes, and the others are as if it weren't there.
    assert by["twice", "again"]["dropped"] and by["twice", "again"]["beta"] is None and not by["twice", "rho"]["dropped"]
    alone = fits.estimate(df, [Fit("two", "y", (a, b))], "unit", "period", draws=0).coefficients.collect()
    assert [by["twice", r["term"]]["beta"] for r in alone] == pytest.approx([r["beta"] for r in alone])
    assert alone[0]["p"] is None


def test_three_periods_have_p_values_of_separate_fits(spark, rows):
    from orrery.operators import regression

    df = spark.createDataFrame(rows, COLUMNS).withColumn("early", ((F.col("period") >= 5) & (F.col("period") < 7)).cast("int"))
    got = {r["term"]: r for r in regression.three_period(df, "rho", "early", "late", "y", "unit", "period", 99).collect()}
    a, b = Term("early", ("rho",), "early"), Term("advanced", ("rho",), "late")
    both = fits.estimate(df, [Fit("f", "y", (a, b))], "unit", "period", 0).coefficients.collect()
    alone = fits.estimate(df, [Fit("a", "y", (a,)), Fit("b", "y", (b,))], "unit", "period", 99).coefficients.collect()
    assert {r["term"]: r["beta"] for r in both} == pytest.approx({k: r["beta"] for k, r in got.items()})
    assert {r["term"]: r["p"] for r in alone} == {k: r["p"] for k, r in got.items()}


def test_what_effects_explain_is_dropped(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).withColumn("always", F.lit(1))
    got = fits.estimate(df, [Fit("f", "y", (Term("fixed", ("rho",), "always"), Term("shock", (), "post"), Term("rho", ("rho",), "post")))], "unit", "period", 0)
    assert [(r["term"], r["dropped"]) for r in got.coefficients.collect()] == [("fixed", True), ("shock", True), ("rho", False)]


def test_jobs_do_not_grow_with_fits(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    a = Term("rho", ("rho",), "post")

    def jobs(n):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"fits{n}", "")
        fits.estimate(df, [Fit(str(k), "y", (a,)) for k in range(n)], "unit", "period", 9)
        return len(tracker.getJobIdsForGroup(f"fits{n}"))

    few, many = jobs(1), jobs(12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= few + 1


def test_empty_panel(spark):
    got = fits.estimate(spark.createDataFrame([], COLUMNS), [Fit("f", "y", (Term("rho", ("rho",), "post"),))], "unit", "period", 9)
    assert got.coefficients.count() == 0 and got.joint.count() == 0


def test_independent():
    x = np.array([[1.0, 2, 0, 3], [0, 0, 1, 1], [1, 2, 2, 5], [4, 8, 1, 13]])
    assert fits.independent(x.T @ x) == [0, 2]
