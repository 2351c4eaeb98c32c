"""From nested company facts to quarterly series.

An entry is a row of (ticker, tag, pos, start, end, val, fp, form, filed), dates as text, pos its place in the file. A
series is a row for each (ticker, tag, label): period_end, fiscal_year, fiscal_quarter (calendar ones), val, filed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.calendar import parsed, quarter_label

ENTRY = T.StructType(
    [T.StructField(n, T.DoubleType() if n == "val" else T.StringType()) for n in ("start", "end", "val", "fp", "form", "filed")]
)
FACTS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("cik", T.LongType()),
        T.StructField(
            "facts",
            T.StructType(
                [T.StructField("us-gaap", T.MapType(T.StringType(), T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(ENTRY)))])))]
            ),
        ),
    ]
)

# Fixed values.
PANEL_START, PANEL_END = "2019-01-01", "2025-12-31"
LONGEST_QUARTER, SHORTEST_YEAR, LONGEST_YEAR, YEAR = 100, 340, 400, 365
STOCK_FORMS = ("10-K", "10-K/A", "10-K405", "10-Q", "10-Q/A")
REVENUE_TAGS = (
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "RevenueFromContractWithCustomerIncludingAssessedTax",
    "Revenues",
    "RevenueFromContractWithCustomer",
)
#: metric: (tags in order of priority, whether a stock, tags to sum where none has data)
METRICS = {
    "cogs": (("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"), False, ()),
    "rd": (("ResearchAndDevelopmentExpense", "ResearchAndDevelopmentExpenseExcludingAcquiredInProcessCost"), False, ()),
    "sga": (("SellingGeneralAndAdministrativeExpense",), False, ("SellingAndMarketingExpense", "GeneralAndAdministrativeExpense")),
    "capex": (("PaymentsToAcquirePropertyPlantAndEquipment",), False, ()),
    "sbc": (("ShareBasedCompensation", "AllocatedShareBasedCompensationExpense"), False, ()),
    "op_income": (("OperatingIncomeLoss",), False, ()),
    "net_income": (("NetIncomeLoss", "ProfitLoss"), False, ()),
    "deferred_rev_current": (("ContractWithCustomerLiabilityCurrent", "DeferredRevenueCurrent"), True, ()),
    "deferred_rev_noncurrent": (("ContractWithCustomerLiabilityNoncurrent", "DeferredRevenueNoncurrent"), True, ()),
}
RPO_TIERS = (
    ("RevenueRemainingPerformanceObligation",),
    ("ContractWithCustomerLiability",),
    ("ContractWithCustomerLiabilityCurrent", "ContractWithCustomerLiabilityNoncurrent"),
    ("DeferredRevenueCurrent", "DeferredRevenueNoncurrent"),
)


def entries(facts: DataFrame, unit: str = "USD") -> DataFrame:
    tags = facts.select("ticker", F.explode("facts.`us-gaap`").alias("tag", "fact"))
    return tags.select("ticker", "tag", F.posexplode(F.try_element_at("fact.units", F.lit(unit))).alias("pos", "e")).select(
        "ticker", "tag", "pos", "e.*"
    )


def first_by(rows: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total for the result to be one."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def keep_latest(rows: DataFrame, keys: list) -> DataFrame:
    """Of each key the row filed last; of those of one day, the first in the file."""
    return first_by(rows, keys, [F.col("filed").desc_nulls_last(), F.col("pos")])


def keep_highest(rows: DataFrame, keys: list) -> DataFrame:
    """Of each key the highest value. A null that comes first in the file is never replaced; a later one replaces nothing."""
    sticky = F.first("val").over(Window.partitionBy(*keys).orderBy("pos")).isNull()
    order = [F.when(F.col("__sticky"), F.col("pos")), F.col("val").desc_nulls_last(), F.col("pos")]
    return first_by(rows.withColumn("__sticky", sticky), keys, order).drop("__sticky")


def _in_panel(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("end").between(PANEL_START, PANEL_END))


def _series(rows: DataFrame) -> DataFrame:
    day = parsed(F.col("end"))
    return rows.select("ticker", "tag", F.col("label"), day.alias("period_end"), F.year(day).alias("fiscal_year"), F.quarter(day).alias("fiscal_quarter"), "val", "filed")


def _days(rows: DataFrame) -> Column:
    return F.datediff(parsed(F.col("end")), parsed(F.col("start")))


def quarterly_flow(rows: DataFrame) -> DataFrame:
    """Quarters as they were reported: no yearly or year-to-date spans, the latest filing of each."""
    short = F.col("start").isNull() | _days(rows).isNull() | (_days(rows) <= LONGEST_QUARTER)
    kept = _in_panel(rows).where(F.coalesce(F.col("fp") != "FY", F.lit(True)) & short)
    labelled = kept.withColumn("label", quarter_label(parsed(F.col("end")))).where("label IS NOT NULL")
    return _series(keep_latest(labelled, ["ticker", "tag", "label"]))


def annual_flow(rows: DataFrame) -> DataFrame:
    """Fiscal years: of each month in which one ends, the highest value."""
    kept = _in_panel(rows).where((F.col("fp") == "FY") & _days(rows).between(SHORTEST_YEAR, LONGEST_YEAR))
    month = kept.withColumn("__month", F.substring("end", 1, 7)).withColumn("label", quarter_label(parsed(F.col("end"))))
    return _series(keep_highest(month, ["ticker", "tag", "__month"]))


def derive_q4(annual: DataFrame, quarters: DataFrame, keys: list[str]) -> DataFrame:
    """The last quarter of each fiscal year as the year less exactly three quarters within it; only if over zero and new."""
    q = quarters.select(*keys, F.col("period_end").alias("q_end"), F.col("val").alias("q_val"))
    inside = annual.join(q, keys).where(
        (F.col("q_end") > F.date_sub("period_end", YEAR)) & (F.col("q_end") <= F.col("period_end"))
    )
    sums = inside.groupBy(*keys, "label", "period_end", "fiscal_year", "fiscal_quarter", "val", "filed").agg(
        F.count("q_val").alias("n"), F.sum("q_val").alias("s")
    )
    fourth = sums.where("n = 3").withColumn("val", F.col("val") - F.col("s")).where("val > 0").drop("n", "s")
    # Of two years that end in one quarter the later one counts.
    one = first_by(fourth, [*keys, "label"], [F.col("period_end").desc()])
    return one.join(quarters.select(*keys, "label"), [*keys, "label"], "left_anti").select(*quarters.columns)


def flow_series(rows: DataFrame) -> DataFrame:
    quarters = quarterly_flow(rows)
    return quarters.unionByName(derive_q4(annual_flow(rows), quarters, ["ticker", "tag"]))


def stock_series(rows: DataFrame) -> DataFrame:
    """Values at quarter ends from annual and quarterly forms, the latest filing of each."""
    kept = _in_panel(rows).where(F.col("form").isin(*STOCK_FORMS) & F.col("val").isNotNull())
    labelled = kept.withColumn("label", quarter_label(parsed(F.col("end")))).where("label IS NOT NULL")
    return _series(keep_latest(labelled, ["ticker", "tag", "label"]))


def _rank(tags: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))


def best_coverage(series: DataFrame, tags: tuple[str, ...], key: str = "ticker") -> DataFrame:
    """Of each key the tag with most quarters, the earlier in ``tags`` where they tie."""
    known = series.where(F.col("tag").isin(*tags))
    n = known.groupBy(key, "tag").agg(F.count("*").alias("n"))
    best = first_by(n, [key], [F.col("n").desc(), _rank(tags)]).select(key, "tag")
    return known.join(best, [key, "tag"])


def first_with_data(series: DataFrame, tags: tuple[str, ...], key: str = "ticker") -> DataFrame:
    """Of each key the first of ``tags`` that has a row."""
    known = series.where(F.col("tag").isin(*tags))
    best = known.groupBy(key).agg(F.min(_rank(tags)).alias("__r"))
    return known.join(best, key).where(_rank(tags) == F.col("__r")).drop("__r")


def accumulate(series: DataFrame, tags: tuple[str, ...], name: str) -> DataFrame:
    """The sum of the components that a quarter has, one at least; dates of the first component in ``tags``."""
    known = series.where(F.col("tag").isin(*tags) & F.col("val").isNotNull()).withColumn("__r", _rank(tags))
    return known.groupBy("ticker", "label").agg(
        *[F.min_by(c, "__r").alias(c) for c in ("period_end", "fiscal_year", "fiscal_quarter")],
        F.sum("val").alias("val"), F.max("filed").alias("filed"),
    ).withColumn("tag", F.lit(name)).select(*series.columns)


def instant_sum(series: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """The sum of two stocks at quarters that have both; where a ticker lacks one wholly, the other alone."""
    known = series.where(F.col("tag").isin(first, second))
    tags = known.groupBy("ticker").agg(F.count_distinct("tag").alias("__tags"))
    sums = known.join(tags, "ticker").groupBy("ticker", "label", "__tags").agg(
        *[F.min_by(c, F.col("tag") != first).alias(c) for c in ("period_end", "fiscal_year", "fiscal_quarter")],
        F.count("*").alias("__n"), F.sum("val").alias("val"), F.max("filed").alias("filed"),
    )
    return sums.where("__n = __tags").withColumn("tag", F.lit(name)).select(*series.columns)


def metric(rows: DataFrame, tags: tuple[str, ...], stock: bool = False, parts: tuple[str, ...] = ()) -> DataFrame:
    """The best covered tag of each ticker; the sum of ``parts`` for tickers that have none."""
    wanted = rows.where(F.col("tag").isin(*tags, *parts))
    series = stock_series(wanted) if stock else flow_series(wanted)
    best = best_coverage(series, tags)
    if not parts:
        return best
    rest = accumulate(series, parts, "+".join(parts))
    return best.unionByName(rest.join(best.select("ticker").distinct(), "ticker", "left_anti").select(*best.columns))


def financial_panel(rows: DataFrame) -> DataFrame:
    """(ticker, period_end, fiscal_quarter, fiscal_year, metric, value) of revenue and all METRICS, nulls left out.

    As ``metric`` gives for each of them, in one pass: all flows and all stocks are made at once, and a ticker's metric picks
    its tag among its own rows.
    """
    known = {"revenue": (REVENUE_TAGS, False, ())} | METRICS
    spec, stocks = {}, []
    for name, (tags, stock, parts) in known.items():
        spec |= {t: (name, k, t in parts) for k, t in enumerate((*tags, *parts))}
        stocks += tags if stock else []
    of_tag = F.create_map(
        *[x for t, (m, k, part) in spec.items() for x in (F.lit(t), F.struct(F.lit(m).alias("metric"), F.lit(k).alias("rank"), F.lit(part).alias("part")))]
    )
    flows = flow_series(rows.where(F.col("tag").isin(*[t for t in spec if t not in stocks])))
    series = flows.unionByName(stock_series(rows.where(F.col("tag").isin(*stocks))))
    marked = series.withColumn("spec", F.element_at(of_tag, F.col("tag"))).select("*", "spec.*")
    marked = marked.withColumn("n", F.count("*").over(Window.partitionBy("ticker", "metric", "tag")))
    order = F.struct((~F.col("part")).alias("single"), "n", (-F.col("rank")).alias("rank"))
    marked = marked.withColumn("order", order).withColumn("best", F.max("order").over(Window.partitionBy("ticker", "metric")))
    # The best single tag, or all parts where none has data.
    chosen = marked.where((F.col("part") & ~F.col("best.single")) | (F.col("order") == F.col("best"))).where("val IS NOT NULL")
    dates = [F.min_by(c, "rank").alias(c) for c in ("period_end", "fiscal_quarter", "fiscal_year")]
    summed = chosen.groupBy("ticker", "metric", "label").agg(*dates, F.sum("val").alias("value"))
    return summed.select("ticker", "period_end", "fiscal_quarter", "fiscal_year", "metric", "value")


def rpo_panel(rows: DataFrame) -> DataFrame:
    """Of each ticker the first tier that has any quarter; a tier of two tags is their instant sum.

    All tiers in one pass: a quarter of a tier counts if it has as many tags as the ticker has in the tier at all. A ticker's rows
    are few and meet once.
    """
    of_tag = F.create_map(*[
        x for k, tier in enumerate(RPO_TIERS) for p, t in enumerate(tier)
        for x in (F.lit(t), F.struct(F.lit(k + 1).alias("tier"), F.lit(p).alias("place"), F.lit("+".join(tier)).alias("name")))
    ])
    wanted = rows.where(F.col("tag").isin(*[t for tier in RPO_TIERS for t in tier])).repartition("ticker")
    marked = stock_series(wanted).withColumn("spec", F.element_at(of_tag, F.col("tag"))).select("*", "spec.*")
    marked = marked.withColumn("tags", F.size(F.collect_set("tag").over(Window.partitionBy("ticker", "tier"))))
    dates = [F.min_by(c, "place").alias(c) for c in ("period_end", "fiscal_quarter", "fiscal_year")]
    sums = marked.groupBy("ticker", "tier", "name", "label", "tags").agg(F.count("*").alias("n"), F.sum("val").alias("rpo_value"), *dates)
    kept = sums.where("n = tags").withColumn("least", F.min("tier").over(Window.partitionBy("ticker"))).where("tier = least")
    return kept.select("ticker", "period_end", "fiscal_quarter", "fiscal_year", "rpo_value", F.col("name").alias("tag_used"))


def lowest_tier(rows: DataFrame, key: str, tier: str = "tier") -> DataFrame:
    """All rows of the lowest tier that each key has."""
    least = rows.groupBy(key).agg(F.min(tier).alias("__t"))
    return rows.join(least, key).where(F.col(tier) == F.col("__t")).drop("__t")


def most_quarters(series: DataFrame, cutoff: str) -> DataFrame:
    """(ticker, n): quarters before the cutoff of the tag that has most."""
    n = series.where(F.col("period_end") < F.lit(cutoff).cast("date")).groupBy("ticker", "tag").agg(F.count("*").alias("n"))
    return n.groupBy("ticker").agg(F.max("n").alias("n"))
