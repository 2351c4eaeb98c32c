import random

import numpy as np
import pytest
from orrery.operators import firm_means as fm
from orrery.operators import quantiles


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = []
    for k in range(15):
        for _ in range([1, 2, 9, 10, 11, 40, 300][k % 7]):
            out.append((k if k else None, float(rng.choice([rng.gauss(k, 3), rng.randrange(4), 1e3 if rng.random() < 0.05 else 2.0]))))
    return [*out, (3, None), (99, None)]


@pytest.mark.parametrize("ranges", [4, 128])
@pytest.mark.parametrize("trim", [0.0, 0.1, 0.25])
def test_trimmed_means(spark, rows, monkeypatch, ranges, trim):
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    got = {r["k"]: r for r in fm.trimmed_means(df, "k", "v", trim).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, v in by.items():
        cut = int(trim * len(v) + 1e-9)
        assert got[k]["n"] == len(v)
        assert got[k]["trimmed"] == pytest.approx(np.mean(sorted(v)[cut : len(v) - cut]))


def test_shrunk_means(spark, rows):
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r for r in fm.shrunk_means(df, "k", "v").collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    n = np.array([len(v) for v in by.values()])
    m = np.array([np.mean(v) for v in by.values()])
    total, g = n.sum(), len(n)
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in by.values()) / (total - g)
    grand = (n * m).sum() / total
    between = max(0, ((n * (m - grand) ** 2).sum() / (g - 1) - within) / ((total - (n**2).sum() / total) / (g - 1)))
    w = between / (between + within / n)
    want = w * m + (1 - w) * ((w * m).sum() / w.sum() if w.sum() else grand)
    for k, a, b in zip(by, w, want, strict=True):
        assert got[k]["weight"] == pytest.approx(a) and got[k]["shrunk"] == pytest.approx(b)


def test_nothing_to_tell(spark):
    one = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double")
    assert {r["k"]: r["shrunk"] for r in fm.shrunk_means(one, "k", "v").collect()} == {1: 3.0, 2: 3.0}
    same = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 2.0), (2, 2.0)], "k int, v double")
    assert {r["shrunk"] for r in fm.shrunk_means(same, "k", "v").collect()} == {2.0}
    apart = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 5.0), (2, 5.0)], "k int, v double")
    assert {r["k"]: (r["weight"], r["shrunk"]) for r in fm.shrunk_means(apart, "k", "v").collect()} == {1: (1.0, 2.0), 2: (1.0, 5.0)}
    assert fm.shrunk_means(one.limit(0), "k", "v").count() == 0 and fm.trimmed_means(one.limit(0), "k", "v").count() == 0
