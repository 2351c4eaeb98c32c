import random

import numpy as np
import pytest
from orrery.operators import multivariate as m


def ranks(v):
    v = np.array(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for _ in range(700):
        x = rng.randrange(40)
        out.append((x if rng.random() < 0.7 else 7, float(x) + rng.gauss(0, 9), rng.choice([1.0, 1.0, 2.5]), 5.0, 2.0 * x if rng.random() < 0.9 else None))
    return out


@pytest.mark.parametrize("least", [2, 64])
def test_rank_correlations(spark, rows, monkeypatch, least):
    monkeypatch.setattr(m, "LEAST_RANGES", least)
    monkeypatch.setattr(m, "VALUES", 30)
    df = spark.createDataFrame(rows, "a int, b double, c double, one double, holes double").repartition(4)
    got = {(r["a"], r["b"]): r for r in m.rank_correlations(df, ["a", "b", "c", "one"]).collect()}
    for i, j in ((0, 1), (0, 2), (1, 2)):
        r = got["abc"[i], "abc"[j]]
        want = np.corrcoef(ranks([x[i] for x in rows]), ranks([x[j] for x in rows]))[0, 1]
        assert r["rho"] == pytest.approx(want, abs=1e-10) and r["n"] == len(rows)
    assert got["a", "one"]["rho"] is None
    full = [x for x in rows if x[4] is not None]
    r = m.rank_correlations(df, ["a", "holes"]).first()
    assert r["n"] == len(full) and r["rho"] == pytest.approx(np.corrcoef(ranks([x[0] for x in full]), ranks([x[4] for x in full]))[0, 1])


def test_ranks_have_no_window_over_all_rows(spark, rows):
    df = spark.createDataFrame(rows, "a int, b double, c double, one double, holes double")
    plan = m.value_ranks(df, "b")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in f" {line.strip('+- :')} "]
    # The one window without a key is over a row for each range.
    assert len(windows) == 2 and sum("range" in line.split("windowspecdefinition")[1].split(",")[0] for line in windows) == 2


def test_collinearity_and_component(spark, rows):
    df = spark.createDataFrame([(*r[:3], 2 * r[0] + 1) for r in rows], "a int, b double, c double, again int")
    x = np.array([r[:3] for r in rows], float)
    r = np.corrcoef(x.T)
    got = {(q["a"], q["b"]): q for q in m.collinearity(df, ["a", "b", "c", "again"]).collect()}
    assert got["a", "b"]["r"] == pytest.approx(r[0, 1]) and got["a", "b"]["vif"] is None
    for i, name in enumerate("abc"):
        assert got[name, name]["vif"] == pytest.approx(np.linalg.inv(r)[i, i])
    assert got["again", "again"]["vif"] == float("inf")
    weights, share = m.first_component(df, ["a", "b", "c"])
    values, vectors = np.linalg.eigh(r)
    v = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
    assert list(weights.values()) == pytest.approx(v.tolist()) and share == pytest.approx(values[-1] / 3)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    some = [q["component"] for q in m.with_component(df.coalesce(1), ["a", "b", "c"]).collect()]
    assert some == pytest.approx((z @ v).tolist())
