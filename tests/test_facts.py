from datetime import date

import pytest
from orrery.operators import facts
from pyspark.sql import functions as F

SCHEMA = "ticker string, tag string, pos int, start string, end string, val double, fp string, form string, filed string"


def rows_of(spark, *rows, tag="T"):
    return spark.createDataFrame([("A", tag, i, *r) for i, r in enumerate(rows)], SCHEMA)


QUARTERS = [
    ("2022-01-01", "2022-03-31", 100.0, "Q1", "10-Q", "2022-05-01"),
    ("2022-01-01", "2022-03-31", 105.0, "Q1", "10-Q", "2022-08-01"),
    ("2022-01-01", "2022-03-31", 999.0, "Q1", "10-Q", "2022-08-01"),
    ("2022-01-01", "2022-06-30", 215.0, "Q2", "10-Q", "2022-08-01"),
    ("2022-04-01", "2022-06-30", 110.0, "Q2", "10-Q", "2022-08-01"),
    (None, "2022-09-30", 120.0, "Q3", "10-Q", "2022-11-01"),
    ("bad", "2018-09-30", 1.0, "Q3", "10-Q", "2018-11-01"),
]
YEARS = [
    ("2022-01-01", "2022-12-31", 480.0, "FY", "10-K", "2023-02-01"),
    ("2022-01-01", "2022-12-31", 470.0, "FY", "10-K/A", "2023-03-01"),
]


def test_quarters_keep_the_latest_filing(spark):
    got = {r.label: r.val for r in facts.quarterly_flow(rows_of(spark, *QUARTERS)).collect()}
    assert got == {"2022Q1": 105, "2022Q2": 110, "2022Q3": 120}


def test_years_and_the_fourth_quarter(spark):
    series = {r.label: (r.val, r.period_end) for r in facts.flow_series(rows_of(spark, *QUARTERS, *YEARS)).collect()}
    assert series["2022Q4"] == (145, date(2022, 12, 31)) and len(series) == 4
    low = [("2022-01-01", "2022-12-31", 300.0, "FY", "10-K", "2023-02-01")]
    assert "2022Q4" not in {r.label for r in facts.flow_series(rows_of(spark, *QUARTERS, *low)).collect()}
    two = [q for q in QUARTERS if q[1] != "2022-09-30"]
    assert "2022Q4" not in {r.label for r in facts.flow_series(rows_of(spark, *two, *YEARS)).collect()}
    null = [*two, (None, "2022-09-30", None, "Q3", "10-Q", "2022-11-01")]
    assert "2022Q4" not in {r.label for r in facts.flow_series(rows_of(spark, *null, *YEARS)).collect()}


@pytest.mark.parametrize(("first", "second", "want"), [(None, 470.0, None), (470.0, None, 470.0), (470.0, 480.0, 480.0)])
def test_a_null_year_sticks_only_if_first(spark, first, second, want):
    rows = [("2022-01-01", "2022-12-31", v, "FY", "10-K", "2023-02-01") for v in (first, second)]
    assert [r.val for r in facts.annual_flow(rows_of(spark, *rows)).collect()] == [want]


def series(spark, tag, values):
    rows = [("A", tag, q, date(2022, 3 * int(q[-1]), 28), 2022, int(q[-1]), float(v), "f" + q) for q, v in values.items()]
    return spark.createDataFrame(rows, "ticker string, tag string, label string, period_end date, fiscal_year int, fiscal_quarter int, val double, filed string")


def test_coverage_sums_and_tiers(spark):
    a, b = series(spark, "c", {"2022Q1": 5, "2022Q2": 6}), series(spark, "n", {"2022Q2": 4, "2022Q3": 3})
    both = a.unionByName(b)
    values = lambda df: {r.label: r.val for r in df.collect()}
    assert values(facts.instant_sum(both, "c", "n", "s")) == {"2022Q2": 10}
    assert values(facts.instant_sum(a, "c", "n", "s")) == {"2022Q1": 5, "2022Q2": 6}
    assert values(facts.accumulate(both, ("c", "n"), "s")) == {"2022Q1": 5, "2022Q2": 10, "2022Q3": 3}
    assert values(facts.best_coverage(both, ("n", "c"))) == {"2022Q2": 4, "2022Q3": 3}
    more = both.unionByName(series(spark, "c", {"2022Q4": 7}))
    assert values(facts.best_coverage(more, ("n", "c"))) == {"2022Q1": 5, "2022Q2": 6, "2022Q4": 7}
    assert values(facts.first_with_data(a, ("n", "c"))) == {"2022Q1": 5, "2022Q2": 6}
    assert facts.most_quarters(both, "2022-07-01").first().n == 2


def test_nested_facts_to_panel(spark):
    keys = [f.name for f in facts.ENTRY.fields]
    revenue = [dict(zip(keys, (s, e, v, fp, fm, fl), strict=True)) for s, e, v, fp, fm, fl in [*QUARTERS, *YEARS]]
    stock = [dict(zip(keys, (None, "2022-03-31", 7.0, "Q1", "10-Q", "2022-05-01"), strict=True)), dict(zip(keys, (None, "2022-06-30", 9.0, "Q2", "8-K", "2022-08-01"), strict=True))]
    tags = {"Revenues": {"units": {"USD": revenue}}, "DeferredRevenueCurrent": {"units": {"USD": stock}}, "SellingAndMarketingExpense": {"units": {"USD": revenue[:1], "EUR": revenue}}}
    df = spark.createDataFrame([("A", 1, {"us-gaap": tags})], facts.FACTS)
    rows = facts.entries(df)
    panel = {(r.metric, r.fiscal_year, r.fiscal_quarter): r.value for r in facts.financial_panel(rows).collect()}
    assert panel["revenue", 2022, 4] == 145 and panel["deferred_rev_current", 2022, 1] == 7 and panel["sga", 2022, 1] == 100
    assert len(panel) == 6
    rpo = facts.rpo_panel(rows).collect()
    assert [(r.rpo_value, r.fiscal_quarter) for r in rpo] == [(7, 1)]
    assert facts.entries(df.limit(0)).count() == 0
    assert rows.agg(F.max("pos")).first()[0] == 8


def test_panel_is_what_each_metric_gives(spark):
    """All metrics in one pass pick the tags that each picks on its own."""
    import random

    rng, rows = random.Random(3), []
    tags = [t for ts, _, parts in [(facts.REVENUE_TAGS, False, ()), *facts.METRICS.values()] for t in (*ts, *parts)]
    for ticker in ("A", "B", "C", "D"):
        for tag in tags:
            if rng.random() < 0.4:
                continue
            for pos, q in enumerate(rng.sample(range(4), rng.randrange(1, 5))):
                end = ("2022-03-31", "2022-06-30", "2022-09-30", "2022-12-31")[q]
                start = ("2022-01-01", "2022-04-01", "2022-07-01", "2022-10-01")[q]
                rows.append((ticker, tag, pos, start, end, rng.choice([None, 1.0, 2.0, 5.0]), f"Q{q + 1}", "10-Q", "2023-01-01"))
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for name, (ts, stock, parts) in ({"revenue": (facts.REVENUE_TAGS, False, ())} | facts.METRICS).items():
        found = facts.metric(df, ts, stock, parts).where("val IS NOT NULL").collect()
        want |= {(r.ticker, r.period_end, r.fiscal_quarter, r.fiscal_year, name, r.val) for r in found}
    assert {tuple(r) for r in facts.financial_panel(df).collect()} == want and len(want) > 40
