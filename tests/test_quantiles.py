import random
import statistics

import pytest
from orrery.operators import quantiles


def brute(values, share):
    v = sorted(values)
    at = (len(v) - 1) * share
    low = int(at)
    high = min(low + (at > low), len(v) - 1)
    return v[low] + (v[high] - v[low]) * (at - low)


@pytest.mark.parametrize("ranges", [128, 3])
def test_exact_percentiles(spark, monkeypatch, ranges):
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    rng = random.Random(1)
    groups = {
        "a": [rng.gauss(0, 1) for _ in range(999)], "b": [float(rng.randrange(3)) for _ in range(500)], "c": [7.5],
        None: [1.0, 2.0, 4.0, None], "ties": [0.0] * 400 + [1.0], "none": [None, None], "wide": [-1e300, 0.0, 1e300, 5e-324],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.percentiles for r in quantiles.exact_percentiles(df, "g", "v", shares).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, found in got.items():
        clean = [v for v in groups[g] if v is not None]
        for p, x in zip(shares, found, strict=True):
            assert x == pytest.approx(brute(clean, p), rel=1e-12, abs=1e-300), (g, p)
    assert got["a"][2] == pytest.approx(statistics.median(groups["a"]))


def test_empty(spark):
    assert quantiles.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0
