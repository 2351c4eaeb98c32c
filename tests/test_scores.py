import math
import random

import numpy as np
import pytest
from orrery.functions import numbers
from orrery.operators import matching, regression, reliability, scoring
from pyspark.sql import functions as F


@pytest.mark.parametrize(("r0", "r1", "r2", "want"), [(5, 0, 1, 9.2), (4, 3, 2, 45.0), (5, 2, 1, 31.9), (0, 8, 0, 100.0), (6, 0, 0, 1.0), (0, 0, 7, 50.5)])
def test_rho(spark, r0, r1, r2, want):
    tasks = spark.createDataFrame([("A", x) for x in ["R0"] * r0 + ["R1"] * r1 + ["R2"] * r2], "ticker string, r_label string")
    assert scoring.supply_scores(tasks, ["ticker"]).first().rho == want


def test_validation(spark):
    demand = lambda *v: spark.range(1).select(scoring.demand_violations(*map(F.lit, v))).first()[0]
    assert demand(0.65, 1.0, 0.6, 0.75) == ["switch grid"] and demand(1.0, 1.0, 0.6, 0.867) == []
    assert demand(1.0, 1.0, 0.6, 0.5) == ["composite"] and "data range" in demand(1.0, 1.0, 1.6, 1.2)
    task = {"task": "t" * 40, "r_label": "R1", "reasoning": "r" * 40}
    schema = "p struct<ticker:string,tasks:array<struct<task:string,r_label:string,reasoning:string>>,overall_reasoning:string>"
    cases = [([task] * 6, "o" * 200, []), ([task] * 5, "o" * 200, ["task count"]), ([task | {"reasoning": "Too fast."}] * 6, "o" * 200, ["reasoning length"]), ([task] * 6, "o" * 30, ["overall length"]), ([task | {"r_label": "R9"}] * 6, "o" * 200, ["label"])]
    df = spark.createDataFrame([(("A", t, o),) for t, o, _ in cases], schema)
    assert [r[0] for r in df.select(scoring.supply_violations(F.col("p"))).collect()] == [w for _, _, w in cases]


def test_iterations_cost_anchors_and_runner(spark):
    rows = spark.createDataFrame([("ZS", 50.0), ("ZS", 60.5), ("MCO", 10.0)], "ticker string, rho double")
    got = {r.ticker: (r.n_iterations, r.rho_mean, r.rho_std) for r in scoring.over_iterations(rows, "ticker").collect()}
    assert got == {"ZS": (2, 55.25, 7.42), "MCO": (1, 10.0, None)}
    checks = {r.ticker: r.verdict for r in scoring.anchor_checks(scoring.over_iterations(rows, "ticker")).collect()}
    assert checks == {"ZS": "WARN", "MCO": "INFO"}
    assert spark.range(1).select(scoring.cost({"input": F.lit(1e6), "output": F.lit(2e6)})).first()[0] == 11.0

    def flaky(text, i):
        if text.startswith("bad") and i == 2:
            raise ValueError("no")
        return [{"task": text, "r_label": "R1"}]

    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "k long, text string")
    got = sorted((r.k, r.iteration, r.error) for r in scoring.run_scorer(docs, "k", iterations=2, scorer=flaky).collect())
    assert got == [(1, 1, None), (1, 2, None), (2, 2, "no")]

    def learns(text, i):
        if "was not valid: too short" not in text:
            raise ValueError("too short")
        return [{"task": text.split("\n")[0], "r_label": "R0"}]

    got = sorted((r.k, r.task, r.error) for r in scoring.run_scorer(docs, "k", scorer=learns).collect())
    assert got == [(1, "good", None), (2, "bad", None)]


def test_unbalanced_effects_match_least_squares(spark):
    """Panels with holes, repeated rows and a null period: the residuals of a regression on all dummies."""
    import random

    import numpy as np

    rng, rows = random.Random(5), []
    for u in range(14):
        for t in [*range(7), None]:
            for _ in range(rng.choice((0, 1, 1, 1, 2))):
                rows.append((u, t, rng.gauss(0, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "firm int, quarter int, y double, x double").repartition(3)
    units, periods = sorted({r[0] for r in rows}), sorted({r[1] for r in rows}, key=str)
    dummies = np.array([[float(r[0] == u) for u in units] + [float(r[1] == t) for t in periods] for r in rows])
    want = {}
    for k in (2, 3):
        v = np.array([r[k] for r in rows])
        want[k] = v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    got = sorted((r.firm, str(r.quarter), r.y, r.x) for r in regression.within(df, "firm", "quarter", ["y", "x"]).collect())
    expected = sorted((r[0], str(r[1]), want[2][k], want[3][k]) for k, r in enumerate(rows))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose(sorted(g[2] for g in got), sorted(e[2] for e in expected), atol=1e-9)
    assert np.allclose(sorted(g[3] for g in got), sorted(e[3] for e in expected), atol=1e-9)


def test_cache_verdicts(spark):
    rows = [("p", 1, 0, 0), ("p", 2, 100, 0), ("p", 3, 0, 95), ("p", 4, 0, 94), ("p", 5, 7, 100), ("q", 1, 50, None), ("q", 2, None, 50)]
    df = spark.createDataFrame(rows, "prompt_hash string, call int, cache_creation long, cache_read long")
    got = [r.verdict for r in scoring.cache_verdicts(df).orderBy("prompt_hash", "call").collect()]
    assert got == ["no_write", "write_ok", "read_ok", "miss", "rewritten", "write_ok", "read_ok"]


def vote(spark, sims, labels=("E1", "E0", "E2")):
    value = {"E0": 0.0, "E1": 1.0, "E2": 0.5}
    rows = [(1, s, k + 1, n, value[n]) for k, (s, n) in enumerate(zip(sims, labels, strict=False))]
    return matching.voted(spark.createDataFrame(rows, "query_id int, similarity double, rank int, label string, beta double")).first()


def test_label_vote(spark):
    r = vote(spark, (0.6, 0.5, 0.4))
    assert (r.label, r.n_matches_used, r.low_confidence) == ("E2", 3, False) and r.beta == pytest.approx(0.53333, abs=1e-4)
    r = vote(spark, (-0.1, -0.2))
    assert (r.label, r.beta, r.n_matches_used, r.low_confidence) == ("E1", 1.0, 1, True)


def test_top_k(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(30)] + [(99, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.match_id) for r in matching.top_k(rows.where("vec_id = 3"), rows, 2).orderBy("rank").collect()]
    assert got[0] == (3, 3) and len(got) == 2
    one = {tuple(r) for r in matching.top_k(rows, rows, 3).collect()}
    monkeypatch.setattr(matching, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in matching.top_k(rows, rows, 3).collect()} == one and len(one) == 31 * 3


def test_top_k_of_odd_vectors_in_any_pieces(spark, monkeypatch):
    """Nulls, NaN, lengths that differ, zeros, opposite and equal vectors: as the sums of each pair say, and no row for each pair in the plan."""
    rng, nan = random.Random(2), float("nan")
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)] if i % 4 else [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(700)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [1.0, 2.0]), (903, []), (904, [nan] * 5), (905, [0.0] * 5), (None, [1.0, 2.0, 3.0, 4.0, 6.0]), (906, [-1.0, -2.0, -3.0, -4.0, -5.0])]
    asked = rows[:20] + rows[-8:]

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        size = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
        return round(sum(x / size(a) * (y / size(b)) for x, y in zip(a, b, strict=True)), 6) + 0.0

    def place(found):
        s, m = found
        return s is None, 0.0 if s is None else -math.inf if math.isnan(s) else -s, -1 if m is None else m

    want = [(q, m, s, r) for q, v in asked for r, (s, m) in enumerate(sorted(((cosine(v, w), m) for m, w in rows), key=place)[:200], 1)]
    schema = "vec_id long, embedding array<double>"
    queries, df = spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema).repartition(3)
    for piece in (None, 150):
        if piece:
            monkeypatch.setattr(matching, "PIECE", piece)
        found = matching.top_k(queries, df, 200)
        assert "NestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "CartesianProduct" not in plan
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    monkeypatch.setattr(matching, "PIECE", 4000)
    for k in (1, 3):
        assert sorted(map(repr, map(tuple, matching.top_k(queries, df, k).collect()))) == sorted(repr(w) for w in want if w[3] <= k)
    assert matching.top_k(queries, df.limit(0), 3).count() == matching.top_k(queries.limit(0), df, 3).count() == 0


def matrix(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "s int, r int, v double")


CLASSIC = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]


def test_icc(spark):
    df = matrix(spark, CLASSIC)
    ms = reliability.squares(df, "s", "r", "v").first()
    assert (round(ms.bms, 4), round(ms.jms, 4), round(ms.ems, 4)) == (11.2417, 32.4861, 1.0194)
    assert reliability.reliability(df, "s", "r", "v")["icc"] == 0.2898
    assert reliability.reliability(df, "s", "r", "v", "consistency")["icc"] == 0.7148
    zero = reliability.reliability(matrix(spark, [(1, 2), (3, 4), (5, 6)]), "s", "r", "v")
    assert zero["icc"] == 0.8889 and math.isinf(zero["f_statistic"]) and math.isnan(zero["ci_lower_95"]) and zero["interpretation"] == "good"
    holes = df.unionByName(spark.createDataFrame([(77, 0, 5.0), (78, 1, None)], "s int, r int, v double"))
    assert reliability.reliability(holes, "s", "r", "v")["icc"] == 0.2898


def test_f_distribution():
    assert reliability.f_cdf(1.0, 5, 5) == pytest.approx(0.5)
    assert reliability.f_quantile(0.95, 5, 10) == pytest.approx(3.3258, abs=1e-4)
    assert reliability.f_cdf(reliability.f_quantile(0.3, 7, 3), 7, 3) == pytest.approx(0.3)


def dummies(n, t, firm, period):
    d = np.zeros((len(firm), n + t - 1))
    for k, (f, p) in enumerate(zip(firm, period, strict=True)):
        d[k, f] = 1
        if p:
            d[k, n + p - 1] = 1
    return d


def test_fixed_effects_match_dummies(spark):
    rng = random.Random(1)
    full = [(f, p, rng.gauss(0, 1) + f, (f % 3) * (p > 2) + rng.gauss(0, 1)) for f in range(8) for p in range(6)]
    for rows in (full, [r for r in full if (r[0] * 5 + r[1]) % 7]):
        y, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        d = dummies(8, 6, [r[0] for r in rows], [r[1] for r in rows])
        want = np.linalg.lstsq(np.c_[x, d], y, rcond=None)[0][0]
        df = spark.createDataFrame(rows, "firm int, quarter int, y double, x double")
        by = regression.balanced_within if len(rows) == len(full) else regression.within
        assert regression.slope(by(df, "firm", "quarter", ["y", "x"])).first().beta == pytest.approx(want, abs=1e-8)


def test_exact_effect_and_bootstrap(spark):
    rows = [(f, p, f * 2.0 + p - 0.3 * (f == 1) * (p > 1), float((f == 1) * (p > 1))) for f in range(3) for p in range(4)]
    out = regression.balanced_within(spark.createDataFrame(rows, "firm int, quarter int, y double, x double"), "firm", "quarter", ["y", "x"])
    assert regression.slope(out).first().beta == pytest.approx(-0.3)
    scores = regression.cluster_scores(out, "firm")
    assert all(abs(r.score) < 1e-12 for r in scores.collect())
    draws = {r.draw: r.b for r in regression.wild_bootstrap(scores, "firm", 19).collect()}
    assert len(draws) == 19 and max(map(abs, draws.values())) < 1e-12


def test_small_functions(spark):
    row = spark.range(1).select(numbers.clipped(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)), numbers.ratio(F.lit(1.0), F.lit(0.0)), numbers.even_round(F.lit(2.5), 0), numbers.stars(F.lit(0.04)), numbers.spearman_brown(F.lit(0.5), 3)).first()
    assert tuple(row) == (None, None, 2.0, "**", 0.75)


def test_did(spark):
    rng = random.Random(3)
    rows = [(f"f{f}", f"{2021 + p // 4}Q{p % 4 + 1}", int(p > 3), 0.5 * (p > 3) * f + f + p + rng.gauss(0, 0.1), float(f), 1 if f else None, 9.0, None) for f in range(12) for p in range(8) if (f + p) % 9]
    schema = "ticker string, year_quarter string, post int, ln_revenue double, score_b double, sme int, pre_rev_m double, gross_margin double"
    panel = spark.createDataFrame(rows, schema)
    fit = regression.did(panel, "score_b", draws=49).first()
    sd = np.std([r[4] for r in rows], ddof=1)
    assert fit.beta == pytest.approx(0.5 * sd, abs=0.1) and fit.n_clusters == 12 and 0 < fit.se < 0.2 and fit.p < 0.1
    assert regression.sample(panel, "sme").select("ticker").distinct().count() == 11 and regression.sample(panel, None).count() == len(rows)
    assert regression.did(panel.where("score_b < 5"), "score_b").count() == 0
    assert [r.outcome for r in regression.mechanisms(panel, "score_b", draws=9).collect()] == ["ln_revenue"]


def test_all_sentences_are_scored(spark, tmp_path):
    from orrery.plans import queries

    text = "A real one. " * 12 + "Some text. " * 9 + "Other words. " * 25000
    spark.createDataFrame([(1, text), (2, "One. Real.")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.iteration): (r.n_tasks, r.n_r1, r.n_r2) for r in queries.offline_scorer(spark, f"file://{tmp_path}").collect()}
    assert got == {(1, i): (25021, 9, 25000) for i in (1, 2)} | {(2, i): (2, 0, 1) for i in (1, 2)}


def test_label_strategies(spark):
    rows = [
        (1, 0.9, 1, "E0", 0.0, 0.0, 0.0), (1, 0.8, 2, "E1", 1.0, 1.0, 1.0), (1, 0.7, 3, "E1", 1.0, 1.0, 1.0),
        (2, 0.4, 1, "E2", 0.0, 0.5, 1.0), (2, -0.3, 2, "E0", 0.0, 0.0, 0.0),
        (3, -0.1, 1, "E1", 1.0, 1.0, 1.0), (3, -0.2, 2, "E0", 0.0, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "query_id int, similarity double, rank int, label string, alpha double, beta double, gamma double")
    top = {r.query_id: (r.label, r.beta, r.n_matches_used, r.strategy, r.low_confidence) for r in matching.labelled(df).collect()}
    assert top == {1: ("E0", 0.0, 1, "top1", False), 2: ("E2", 0.5, 1, "top1", True), 3: ("E1", 1.0, 1, "top1", True)}
    got = {r.query_id: r for r in matching.labelled(df, "weighted_majority").collect()}
    assert got[1].label == "E2" and got[1].beta == pytest.approx(1.5 / 2.4) and got[1].alpha == pytest.approx(1.5 / 2.4) and got[1].n_matches_used == 3
    assert (got[2].label, got[2].beta, got[2].low_confidence) == ("E2", 0.5, True)
    assert (got[3].label, got[3].strategy, got[3].n_matches_used, got[3].low_confidence) == ("E1", "weighted_majority_fallback_top1", 1, True)
    with pytest.raises(ValueError):
        matching.labelled(df, "other")
