from datetime import date

import pytest
from orrery.operators import panels
from orrery.streaming import upserts


def test_billings_and_gaps(spark):
    days = [date(2022, 3, 31), date(2022, 6, 30), date(2022, 9, 30), date(2023, 3, 31), date(2023, 6, 30)]
    revenue = spark.createDataFrame([("A", d, 10.0 + i) for i, d in enumerate(days)], "ticker string, period_end date, revenue double")
    stock = spark.createDataFrame([("A", d, v) for d, v in zip(days, [100.0, 110.0, None, 130.0, 125.0], strict=True)], "ticker string, period_end date, rpo_value double")
    rows = panels.billings(revenue, stock)
    got = rows.orderBy("period_end").collect()
    assert [r.rpo_delta for r in got] == [None, 10, None, None, -5]
    assert [r.billings for r in got] == [None, 21, None, None, 9]
    status = panels.billings_status(rows).first()
    assert (status.n_billings, status.n_gaps, status.status) == (2, 1, "sparse")


def test_a_gap_of_exactly_the_limit_is_kept(spark):
    for day, want in ((date(2022, 5, 1), 5.0), (date(2022, 5, 2), None)):
        two = [("A", date(2022, 1, 1), 1.0), ("A", day, 6.0)]
        rows = spark.createDataFrame(two, "ticker string, period_end date, rpo_value double")
        got = panels.billings(rows.selectExpr("ticker", "period_end", "0D AS revenue"), rows).orderBy("period_end").collect()
        assert got[1].rpo_delta == want


def test_ratios(spark):
    schema = "k int, metric string, value double"
    long = [(1, "revenue", 100.0), (1, "cogs", 40.0), (1, "rd", 20.0), (1, "sga", 10.0), (2, "revenue", 0.0), (2, "cogs", 1.0), (3, "revenue", -50.0), (3, "cogs", 10.0)]
    rows = panels.with_ratios(panels.widened(spark.createDataFrame(long, schema), ["k"], panels.MARGIN_METRICS)).orderBy("k").collect()
    assert [rows[0][r] for r in panels.RATIOS] == [0.6, 0.2, 0.1, None, 0.7]
    assert [rows[1][r] for r in panels.RATIOS] == [None] * 5
    assert rows[2].gross_margin == pytest.approx(1.2)
    assert panels.lengthened(spark.createDataFrame([(1, None, 2.0)], "k int, a double, b double"), ["k"], ("a", "b")).count() == 2


def test_winsorized_keeps_nulls(spark):
    rows = [("m", float(v)) for v in range(101)] + [("m", None), ("m", float("nan"))]
    got = panels.winsorized(spark.createDataFrame(rows, "metric string, value double")).collect()
    by = {r.value: r.value_winsorized for r in got}
    assert (by[0], by[1], by[50], by[100], by[None]) == (1, 1, 50, 99, None)


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    new = spark.createDataFrame([("B", 3)], "k string, v int")
    assert {tuple(r) for r in panels.upserted(old, new, ["k"]).collect()} == {("A", 1), ("B", 3)}
    assert [r.k for r in panels.carried_over(old, new, "k").collect()] == ["A"]
    run = upserts.upsert_batches(f"file://{tmp_path}/t", ["k"], "v")
    run(old, 0)
    run(new.unionByName(spark.createDataFrame([("B", 9)], "k string, v int")), 1)
    run(new, 1)
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/t/v=1").collect()} == {("A", 1), ("B", 3)}


def test_what_to_process(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ok", True), ("ok", False), ("gone", False), ("failed", True), (None, False)], "s string, there boolean")
    pick = lambda **k: [r[0] for r in df.select(panels.to_process(F.col("s"), F.col("there"), ("gone",), ("failed",), **k)).collect()]
    assert pick() == [False, True, False, False, True] and pick(named=True) == [True] * 5
    assert pick(skip=False) == [True, True, False, True, True] and pick(retry=True) == [False, True, False, True, True]
