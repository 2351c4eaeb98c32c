"""Queries over the standard tables that exercise the operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar, numbers, text
from ..operators import facts, filings, lexicon, matching, panels, quantiles, regression, reliability, scoring, universe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


# --- margins -------------------------------------------------------------------------------------------------------


def supplier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier, quarter, metric, value): shipments as the metrics of a firm."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", calendar.quarter_label(F.col("l_shipdate")).alias("label"), "l_returnflag", money("l_extendedprice").alias("price"),
        money("l_quantity").alias("quantity"),
    )
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("price")))
    wide = rows.groupBy("l_suppkey", "label").agg(
        F.sum("price").cast("double").alias("revenue"), flag("R").cast("double").alias("cogs"), flag("A").cast("double").alias("rd"),
        flag("N").cast("double").alias("sga"), F.sum("quantity").cast("double").alias("sbc"),
    )
    return panels.lengthened(wide, ["l_suppkey", "label"], panels.MARGIN_METRICS)


_METRICS_SQL = """
wide AS (SELECT l_suppkey, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS label,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R') AS DOUBLE) AS cogs,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'A') AS DOUBLE) AS rd,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'N') AS DOUBLE) AS sga,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sbc
  FROM lineitem GROUP BY ALL)"""

_MARGIN_SQL = f"""
WITH {_METRICS_SQL},
ratios AS (SELECT l_suppkey, label, unnest(['gross_margin', 'rd_intensity', 'sga_intensity', 'sbc_intensity', 'opex_ratio']) AS metric,
    unnest([(revenue - cogs) / nullif(revenue, 0), rd / nullif(revenue, 0), sga / nullif(revenue, 0), sbc / nullif(revenue, 0),
      (cogs + rd + sga) / nullif(revenue, 0)]) AS value FROM wide),
bounds AS (SELECT metric, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM ratios GROUP BY metric)
SELECT l_suppkey, label, ratios.metric, round_even(value, 8) AS value,
  round_even(CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END, 8) AS value_winsorized
FROM ratios JOIN bounds USING (metric)"""


@query("margin_panel_winsorized", _MARGIN_SQL)
def margin_panel_winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panels.margin_panel(supplier_metrics(spark, sf_dir), ["l_suppkey", "label"])
    return out.select("l_suppkey", "label", "metric", F.bround("value", 8).alias("value"), F.bround("value_winsorized", 8).alias("value_winsorized"))


@query(
    "long_metric_panel",
    f"""WITH {_METRICS_SQL} SELECT l_suppkey, label, unnest(['revenue', 'cogs', 'rd', 'sga', 'sbc']) AS metric,
    unnest([revenue, cogs, rd, sga, sbc]) AS value FROM wide""",
)
def long_metric_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_metrics(spark, sf_dir)


# --- stocks and flows ----------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", money("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("day")
    )


def _billings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of a customer's order days; the stock is what finished orders of the day hold."""
    days = _orders(spark, sf_dir).groupBy("o_custkey", "day")
    revenue = days.agg(F.sum("price").alias("revenue"))
    stock = _orders(spark, sf_dir).where("o_orderstatus = 'F'").groupBy("o_custkey", "day").agg(F.sum("price").alias("rpo_value"))
    return panels.billings(revenue, stock, "o_custkey", "day")


_BILLINGS_SQL = """
rev AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY ALL),
stock AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS rpo_value
  FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
joined AS (SELECT * FROM rev LEFT JOIN stock USING (o_custkey, day)),
lagged AS (SELECT *, day - lag(day) OVER w AS gap, rpo_value - lag(rpo_value) OVER w AS change
  FROM joined WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
billed AS (SELECT o_custkey, day, revenue, rpo_value, CASE WHEN gap <= 120 THEN change END AS rpo_delta,
  revenue + CASE WHEN gap <= 120 THEN change END AS billings FROM lagged)"""


@query(
    "billings_gap_aware",
    f"""WITH {_BILLINGS_SQL} SELECT o_custkey, day, CAST(revenue AS DOUBLE) AS revenue, CAST(rpo_value AS DOUBLE) AS rpo_value,
    CAST(rpo_delta AS DOUBLE) AS rpo_delta, CAST(billings AS DOUBLE) AS billings FROM billed""",
)
def billings_gap_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _billings(spark, sf_dir).select("o_custkey", "day", *[F.col(c).cast("double").alias(c) for c in ("revenue", "rpo_value", "rpo_delta", "billings")])


_STATUS_SQL = f"""
WITH {_BILLINGS_SQL},
gaps AS (SELECT o_custkey, count(*) FILTER (g > 120) AS n_gaps FROM (SELECT o_custkey,
  day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS g FROM billed WHERE rpo_value IS NOT NULL) GROUP BY o_custkey),
status AS (SELECT o_custkey, count(billings) AS n_billings, coalesce(any_value(n_gaps), 0) AS n_gaps,
  CASE WHEN count(billings) >= 6 THEN 'computable' WHEN count(billings) >= 1 THEN 'sparse' ELSE 'none' END AS status
  FROM billed LEFT JOIN gaps USING (o_custkey) GROUP BY o_custkey)"""


@query("gap_counts_status", f"{_STATUS_SQL} SELECT * FROM status")
def gap_counts_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.billings_status(_billings(spark, sf_dir), "o_custkey", "day")


@query(
    "qa_status_summary",
    f"""{_STATUS_SQL} SELECT status, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share,
    min(o_custkey) || ' to ' || max(o_custkey) AS key_range FROM status GROUP BY status""",
)
def qa_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = panels.billings_status(_billings(spark, sf_dir), "o_custkey", "day")
    n = per.groupBy("status").agg(F.count("*").alias("n"), F.concat(F.min("o_custkey").cast("string"), F.lit(" to "), F.max("o_custkey").cast("string")).alias("key_range"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("status", "n", F.bround(100 * F.col("n") / F.col("total"), 4).alias("share"), "key_range")


# --- picks ---------------------------------------------------------------------------------------------------------


@query(
    "dedupe_latest_in_quarter",
    """SELECT o_custkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, o_orderkey, o_totalprice AS val FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, label ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1""",
)
def dedupe_latest_in_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", calendar.quarter_label(F.col("o_orderdate")).alias("label"), F.to_date("o_orderdate").alias("filed"),
        F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("val"),
    )
    return facts.keep_latest(rows, ["o_custkey", "label"]).select("o_custkey", "label", F.col("pos").alias("o_orderkey"), "val")


@query(
    "dedupe_highest_annual",
    """SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, o_orderkey, o_totalprice AS val FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
def dedupe_highest_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("val"))
    return facts.keep_highest(rows, ["o_custkey", "year"]).select("o_custkey", "year", F.col("pos").alias("o_orderkey"), "val")


@query(
    "derive_q4",
    """WITH q AS (SELECT l_suppkey, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS val
      FROM lineitem GROUP BY ALL),
    fy AS (SELECT l_suppkey, y, sum(val) AS total FROM q GROUP BY ALL),
    three AS (SELECT l_suppkey, y, count(val) AS n, sum(val) AS s FROM q WHERE q < 4 GROUP BY ALL)
    SELECT l_suppkey, CAST(y AS INT) AS fiscal_year, y || 'Q4' AS label, CAST(total - s AS DOUBLE) AS val
    FROM fy JOIN three USING (l_suppkey, y) WHERE n = 3 AND total - s > 0""",
)
def derive_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quarter from yearly totals and the first three quarters."""
    q = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("fiscal_year"), F.quarter("l_shipdate").alias("fiscal_quarter")).agg(
        F.sum(money("l_extendedprice")).alias("val")
    )
    end = F.last_day(F.make_date("fiscal_year", F.col("fiscal_quarter") * 3, F.lit(1)))
    label = F.concat(F.col("fiscal_year").cast("string"), F.lit("Q"), F.col("fiscal_quarter").cast("string"))
    columns = ["l_suppkey", "label", "period_end", "fiscal_year", "fiscal_quarter", "val", "filed"]
    quarters = q.where("fiscal_quarter < 4").withColumn("period_end", end).withColumn("label", label).withColumn("filed", F.col("period_end"))
    annual = q.groupBy("l_suppkey", "fiscal_year").agg(F.sum("val").alias("val")).withColumn("fiscal_quarter", F.lit(4))
    annual = annual.withColumn("period_end", end).withColumn("label", label).withColumn("filed", F.col("period_end"))
    found = facts.derive_q4(annual.select(columns), quarters.select(columns), ["l_suppkey"])
    return found.select("l_suppkey", "fiscal_year", "label", F.col("val").cast("double").alias("val"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as series: the priority is the tag, the latest order of a quarter its value."""
    rows = _orders(spark, sf_dir).withColumn("label", calendar.quarter_label(F.col("day")))
    rows = rows.select(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("tag"), "label", F.col("day").alias("filed"), F.col("o_orderkey").alias("pos"), F.col("price").alias("val"))
    one = facts.keep_latest(rows, ["ticker", "tag", "label"])
    return one.select("ticker", "tag", "label", F.col("filed").alias("period_end"), F.year("filed").alias("fiscal_year"), F.quarter("filed").alias("fiscal_quarter"), "val", "filed")


_TAGGED_SQL = """
tagged AS (SELECT o_custkey AS ticker, o_orderpriority AS tag, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label,
    CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS val FROM orders
  QUALIFY row_number() OVER (PARTITION BY ticker, tag, label ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1)"""
PRIORITIES = ("3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW")
_RANK_SQL = "list_position(['3-MEDIUM', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW'], tag)"


@query(
    "best_coverage_tag",
    f"""WITH {_TAGGED_SQL}, best AS (SELECT * FROM (SELECT ticker, tag, count(*) AS n FROM tagged GROUP BY ticker, tag)
      QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, {_RANK_SQL}) = 1)
    SELECT ticker, tag, label, CAST(val AS DOUBLE) AS val FROM tagged JOIN best USING (ticker, tag)""",
)
def best_coverage_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.best_coverage(_tagged(spark, sf_dir), PRIORITIES).select("ticker", "tag", "label", F.col("val").cast("double").alias("val"))


@query(
    "first_tag_with_data",
    f"""WITH {_TAGGED_SQL}, best AS (SELECT ticker, min({_RANK_SQL}) AS r FROM tagged GROUP BY ticker)
    SELECT ticker, tag, label, CAST(val AS DOUBLE) AS val FROM tagged JOIN best USING (ticker) WHERE {_RANK_SQL} = r""",
)
def first_tag_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.first_with_data(_tagged(spark, sf_dir), PRIORITIES).select("ticker", "tag", "label", F.col("val").cast("double").alias("val"))


@query(
    "tier_fallback_first",
    """SELECT o_custkey, o_orderkey, tier FROM (SELECT *, CAST(left(o_orderpriority, 1) AS INT) AS tier FROM orders)
    QUALIFY tier = min(tier) OVER (PARTITION BY o_custkey)""",
)
def tier_fallback_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"))
    return facts.lowest_tier(rows, "o_custkey").select("o_custkey", "o_orderkey", "tier")


_PAIR_SQL = f"WITH {_TAGGED_SQL}, pair AS (SELECT *, count(DISTINCT tag) OVER (PARTITION BY ticker) AS tags FROM tagged WHERE tag IN ('1-URGENT', '2-HIGH'))"


@query(
    "instant_sum_inner",
    f"""{_PAIR_SQL} SELECT ticker, label, CAST(sum(val) AS DOUBLE) AS val, max(day) AS filed FROM pair
    GROUP BY ticker, label, tags HAVING count(*) = tags""",
)
def instant_sum_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.instant_sum(_tagged(spark, sf_dir), "1-URGENT", "2-HIGH", "sum").select("ticker", "label", F.col("val").cast("double").alias("val"), "filed")


@query("accumulate_outer", f"{_PAIR_SQL} SELECT ticker, label, CAST(sum(val) AS DOUBLE) AS val, max(day) AS filed FROM pair GROUP BY ALL")
def accumulate_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.accumulate(_tagged(spark, sf_dir), ("1-URGENT", "2-HIGH"), "sum").select("ticker", "label", F.col("val").cast("double").alias("val"), "filed")


@query(
    "asof_before_cutoff",
    """SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderstatus = 'P' AS INT), CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1""",
)
def asof_before_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the latest order before a day; partial ones stand for amended filings."""
    rows = _orders(spark, sf_dir)
    listed = rows.withColumn("position", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("day").desc(), "o_orderkey")))
    early = listed.withColumn("day_text", F.date_format("day", "yyyy-MM-dd"))
    found = universe.latest_before(early, "o_custkey", "day_text", "1998-01-01", F.col("o_orderstatus") == "P", "position")
    return found.select("o_custkey", "o_orderkey", "day", "o_orderstatus")


# --- universe ------------------------------------------------------------------------------------------------------


@query(
    "universe_tier_case",
    """SELECT c_custkey, c_mktsegment, r_name, CASE WHEN c_mktsegment = 'BUILDING' AND r_name IN ('ASIA', 'EUROPE') THEN 'placebo_both'
      WHEN c_mktsegment = 'BUILDING' THEN 'primary_software' WHEN r_name = 'AFRICA' THEN 'primary_knowledge' ELSE 'placebo' END AS tier,
      contains(lower(c_name), '#00000000') OR contains(lower(c_name), '7') AS consumer_flag
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE (c_mktsegment = 'BUILDING' OR r_name IN ('AFRICA', 'ASIA', 'EUROPE')) AND upper(c_mktsegment) <> 'MACHINERY' AND c_acctbal BETWEEN 0 AND 9000""",
)
def universe_tier_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    listed = F.when(F.col("r_name") == "AFRICA", "primary_knowledge").when(F.col("r_name").isin("ASIA", "EUROPE"), "placebo")
    rows = rows.withColumn("tier", universe.tier(F.col("c_mktsegment") == "BUILDING", listed)).where("tier IS NOT NULL")
    rows = rows.where(~F.upper("c_mktsegment").isin("MACHINERY") & F.col("c_acctbal").between(0, 9000))
    return rows.select("c_custkey", "c_mktsegment", "r_name", "tier", universe.consumer_flag(F.col("c_name"), ("#00000000", "7")).alias("consumer_flag"))


@query(
    "universe_min_history",
    f"""WITH {_TAGGED_SQL} SELECT ticker, max(n) AS n FROM (SELECT ticker, tag, count(*) AS n FROM tagged WHERE day < DATE '1999-01-01'
    GROUP BY ALL) GROUP BY ticker HAVING max(n) >= 3""",
)
def universe_min_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.most_quarters(_tagged(spark, sf_dir), "1999-01-01").where("n >= 3")


@query(
    "manual_union_missing",
    """SELECT c_custkey, c_mktsegment, 'found' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL
    SELECT c_custkey, c_mktsegment, 'listed' FROM customer WHERE c_nationkey < 5 AND c_acctbal <= 0""",
)
def manual_union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    found = c.where("c_acctbal > 0").select("c_custkey", "c_mktsegment", F.lit("found").alias("origin"))
    listed = c.where("c_nationkey < 5").select("c_custkey", "c_mktsegment", F.lit("listed").alias("origin"))
    return universe.with_missing(found, listed, "c_custkey")


@query(
    "upsert_replace_keys",
    """SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size >= 20 UNION ALL
    SELECT p_partkey, p_brand, p_retailprice + 1 FROM part WHERE p_size < 20""",
)
def upsert_replace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.select("p_partkey", "p_brand", "p_retailprice")
    new = part.where("p_size < 20").select("p_partkey", "p_brand", (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return panels.upserted(old, new, ["p_partkey"])


@query(
    "carry_over_missing",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
)
def carry_over_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished urgent order."""
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return panels.carried_over(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query(
    "sector_members",
    "SELECT c_nationkey, c_mktsegment, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS members, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment",
)
def sector_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.sort_array(F.collect_list(F.col("c_custkey").cast("string"))), ",").alias("members"), F.count("*").alias("n"))


# --- keys and periods ----------------------------------------------------------------------------------------------


@query(
    "period_labels",
    """SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, CAST(CAST(o_orderdate AS DATE) >= DATE '1998-10-01' AS INT) AS post,
    CAST(CAST(o_orderdate AS DATE) >= DATE '1998-10-01' AND CAST(o_orderdate AS DATE) < DATE '2000-01-01' AS INT) AS early,
    CAST(CAST(o_orderdate AS DATE) >= DATE '2000-01-01' AS INT) AS advanced FROM orders""",
)
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    dummies = calendar.period_dummies(day, "1998-10-01", "2000-01-01")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.quarter_label(day).alias("label"), *[v.alias(k) for k, v in dummies.items()])


@query(
    "estimate_period_end",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) - CASE WHEN o_orderstatus = 'F' THEN 75 ELSE 35 END AS period_end FROM orders""",
)
def estimate_period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("o_orderstatus") == "F", "10-K/A").otherwise("10-Q")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.estimated_period_end(F.to_date("o_orderdate"), form).alias("period_end"))


@query(
    "canonical_keys",
    """WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(c_custkey * 1000003 AS VARCHAR), 18, '0') AS raw FROM customer)
    SELECT c_custkey, cik, left(raw, 10) || '-' || substr(raw, 11, 2) || '-' || substr(raw, 13, 6) AS accession, substr(sha256(raw), 1, 16) AS digest FROM k""",
)
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.lpad((F.col("c_custkey") * 1000003).cast("string"), 18, "0")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.padded_key(F.col("c_custkey")).alias("cik"), text.accession(raw).alias("accession"), text.short_digest(raw).alias("digest")
    )


# --- texts ---------------------------------------------------------------------------------------------------------

#: A lexicon of words that the tables' texts have; longer ones contain shorter ones.
TERMS = ((r"\bthe\b", "core"), (r"\bthe and\b", "core"), (r"\bof the\b", "named_product"), (r"\bidiot\b", "technical"), (r"\bmoron\b", "technical"))
# RE2 knows only ASCII word ends: texts are split into runs of word characters and runs of others, and terms are looked for
# among those. A term of two words takes both, so a single word in one isn't counted again.
_WORD = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}"
_SPACE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LEXICON_SQL = rf"""
runs AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[{_WORD}]+|[^{_WORD}]+') AS r FROM documents),
spots AS (SELECT doc_id, lang, text, r, list_filter(range(1, len(r) + 1), lambda i: r[i] = 'the') AS the FROM runs),
kinds AS (SELECT doc_id, lang, text,
    len(list_filter(the, lambda i: i > 2 AND r[i - 1] = ' ' AND r[i - 2] = 'of')) AS n_of_the, len(the) AS n_the,
    len(list_filter(r, lambda x: x IN ('idiot', 'moron'))) AS n_insults FROM spots),
counted AS (SELECT doc_id, lang, CAST(n_the + n_insults AS BIGINT) AS n_mentions_total,
  CAST(n_the - n_of_the AS BIGINT) AS n_mentions_core, CAST(n_of_the AS BIGINT) AS n_mentions_named_product,
  CAST(n_insults AS BIGINT) AS n_mentions_technical,
  CAST(len(list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '')) AS BIGINT) AS filing_words FROM kinds),
panel AS (SELECT *, coalesce(round_even(n_mentions_total / nullif(filing_words, 0) * 1000, 4), 0.0) AS mention_density FROM counted)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in all documents, with Unicode word ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return lexicon.counted(docs, "text", TERMS).drop("text")


@query("lexicon_counts", f"WITH {_LEXICON_SQL} SELECT * FROM panel")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


@query("mention_top20", f"WITH {_LEXICON_SQL} SELECT doc_id, n_mentions_total FROM panel ORDER BY n_mentions_total DESC, doc_id LIMIT 20")
def mention_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the twenty with most mentions."""
    return _mentions(spark, sf_dir).select("doc_id", "n_mentions_total").orderBy(F.col("n_mentions_total").desc(), "doc_id").limit(20)


@query("zero_mention", f"WITH {_LEXICON_SQL} SELECT lang, count(*) AS n FROM panel WHERE n_mentions_total = 0 GROUP BY lang")
def zero_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).where("n_mentions_total = 0").groupBy("lang").agg(F.count("*").alias("n"))


@query("median_density", f"WITH {_LEXICON_SQL} SELECT lang, round_even(median(mention_density), 6) AS density FROM panel GROUP BY lang")
def median_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = quantiles.exact_percentiles(_mentions(spark, sf_dir), "lang", "mention_density", [0.5], "p")
    return half.select("lang", F.bround(F.col("p")[0], 6).alias("density"))


@query(
    "frontmatter_item",
    """SELECT doc_id, trim(text, chr(10) || chr(13) || chr(9) || ' ') AS item_1 FROM documents""",
)
def frontmatter_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written with marks and read back."""
    docs = table(spark, sf_dir, "documents")
    marked = filings.marked_text({"ticker": F.col("source")}, {"1": F.col("text"), "1A": F.col("lang")})
    return docs.select("doc_id", filings.front_matter_item(marked, "1").alias("item_1"))


_BLOCKS_SQL = "|".join(sorted(filings.BLOCKS))
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"))
_UNESCAPED = "t"
for _name, _char in _ENTITIES:
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_char}')"
_UNESCAPED = f"regexp_replace({_UNESCAPED}, '&amp;?', '&', 'g')"

#: Tags by patterns, which the tables' pages allow: no attribute has a '>' in it, and entities are those of _ENTITIES. What a
#: page that breaks off leaves open is lost: a tag, a comment, a script, or text since the last tag with an open entity.
HTML_SQL = rf"""
WITH closed AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?(</(script|style)>|$)', '', 'g'),
    '(?s)<!--.*?(-->|$)', '', 'g'), '(<[^>]*|[^<>]*&[^\s;<>]{{0,33}})$', '') AS html FROM pages),
bare AS (SELECT page_id, regexp_replace(html, '(?i)</?({_BLOCKS_SQL})(\s[^>]*)?/?>', chr(10), 'g') AS t FROM closed),
plain AS (SELECT page_id, regexp_replace(t, '<[/!?a-zA-Z][^>]*>', '', 'g') AS t FROM bare),
decoded AS (SELECT page_id, replace(replace({_UNESCAPED}, chr(160), ' '), chr(8203), '') AS t FROM plain),
text AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM decoded)
SELECT page_id, text, CAST(len(list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '')) AS BIGINT) AS words FROM text
""".replace("\\\\", "\\")


@query("html_to_text", HTML_SQL)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = filings.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("text")).select("page_id", "text", text.word_count(F.col("text")).alias("words"))


@query("section_extract")
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents set up as annual filings."""
    body = F.concat(F.lit("Item 1. Business\nItem 1A. Risk Factors\nItem 1. Business\n"), F.col("text"), F.lit("\nItem 1A. Risk Factors\n"), F.col("text"), F.lit("\nItem 2. Properties\n"))
    return table(spark, sf_dir, "documents").select("doc_id", filings.sections(body, F.lit("10-K")).alias("s")).select("doc_id", "s.*")


@query("line_clean")
def line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filings.cleaned(F.col("text")).alias("text"))


# --- events --------------------------------------------------------------------------------------------------------


@query(
    "pre_post_ratio",
    """WITH e AS (SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS pre, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS post FROM events GROUP BY event_type)
    SELECT event_type, pre, post, round_even(post / nullif(pre, 0), 6) AS ratio, round_even(100.0 * post / sum(post) OVER (), 6) AS share FROM e""",
)
def pre_post_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("ts") < cut).alias("pre"), F.count_if(F.col("ts") >= cut).alias("post"))
    total = n.agg(F.sum("post").alias("total"))
    return n.join(F.broadcast(total)).select(
        "event_type", "pre", "post", F.bround(numbers.ratio(F.col("post"), F.col("pre")), 6).alias("ratio"),
        F.bround(100.0 * F.col("post") / F.col("total"), 6).alias("share"),
    )


@query("json_prop_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("label_beta_consistency", "SELECT quality, CAST(min(toxic) AS DOUBLE) AS low, CAST(max(toxic) AS DOUBLE) AS high, round_even(avg(toxic), 8) AS mean, count(*) AS n FROM labels GROUP BY quality")
def label_beta_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("beta", F.col("toxic").cast("double"))
    return matching.consistency(rows, "quality", "beta").withColumn("mean", F.bround("mean", 8))


_RUBRIC_SQL = """
scored AS (SELECT user_id, event_id % 3 + 1 AS iteration, count(*) AS n_tasks, count(*) FILTER (event_type = 'click') AS n_r1,
  count(*) FILTER (event_type = 'view') AS n_r2 FROM events GROUP BY ALL),
rho AS (SELECT *, CAST(round_even(CAST((n_r1 + n_r2 * 0.5) / n_tasks * 99 + 1 AS DECIMAL(18,9)), 1) AS DOUBLE) AS rho FROM scored)"""


def _rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "click", "R1").when(F.col("event_type") == "view", "R2").otherwise("R0")
    tasks = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3 + 1).alias("iteration"), label.alias("r_label"))
    return scoring.supply_scores(tasks, ["user_id", "iteration"])


@query("rubric_score", f"WITH {_RUBRIC_SQL} SELECT * FROM rho")
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rubric(spark, sf_dir)


@query(
    "iteration_mean_std",
    f"""WITH {_RUBRIC_SQL} SELECT user_id, count(rho) AS n_iterations, round_even(avg(rho), 2) AS rho_mean, round_even(stddev_samp(rho), 2) AS rho_std,
    max(rho) FILTER (iteration = 1) AS rho_iter1, max(rho) FILTER (iteration = 2) AS rho_iter2, max(rho) FILTER (iteration = 3) AS rho_iter3 FROM rho GROUP BY user_id""",
)
def iteration_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rubric(spark, sf_dir)
    slots = rows.groupBy("user_id").pivot("iteration", [1, 2, 3]).agg(F.max("rho"))
    slots = slots.select("user_id", *[F.col(str(k)).alias(f"rho_iter{k}") for k in (1, 2, 3)])
    return scoring.over_iterations(rows, "user_id").join(slots, "user_id")


@query(
    "composite_validation",
    """WITH s AS (SELECT p_partkey, (p_size % 11) / 10.0 AS a, (p_size % 7) / 10.0 AS b, (p_size % 5) / 8.0 AS c FROM part),
    m AS (SELECT *, round_even(CAST((a + b + c) / 3 AS DOUBLE), 3) + CASE WHEN p_partkey % 3 = 0 THEN 0.02 ELSE 0 END AS composite FROM s)
    SELECT p_partkey, list_filter([CASE WHEN abs(CAST(c AS DOUBLE) * 10 - round_even(CAST(c AS DOUBLE) * 10, 0)) > 1e-6 THEN 'data grid' END,
      CASE WHEN p_partkey % 3 = 0 THEN 'composite' END], lambda x: x IS NOT NULL) AS violations FROM m""",
)
def composite_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    a, b, c = (size % 11) / 10.0, (size % 7) / 10.0, (size % 5) / 8.0
    composite = F.bround((a + b + c) / 3, 3) + F.when(F.col("p_partkey") % 3 == 0, 0.02).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", scoring.demand_violations(a, b, c, composite).alias("violations"))


@query(
    "usage_cost_totals",
    """SELECT count(DISTINCT conv_id) AS calls, CAST(sum(length(text)) FILTER (role = 'user') AS BIGINT) AS input_chars, CAST(sum(length(text)) FILTER (role <> 'user') AS BIGINT) AS output_chars,
    round_even(sum(length(text)) FILTER (role = 'user') * 1.0 / 1e6 + sum(length(text)) FILTER (role <> 'user') * 5.0 / 1e6, 6) AS cost FROM conversations""",
)
def usage_cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    sums = table(spark, sf_dir, "conversations").agg(
        F.count_distinct("conv_id").alias("calls"), F.sum(F.when(F.col("role") == "user", n)).alias("input_chars"), F.sum(F.when(F.col("role") != "user", n)).alias("output_chars")
    )
    return sums.withColumn("cost", F.bround(scoring.cost({"input": F.col("input_chars"), "output": F.col("output_chars")}), 6))


@query(
    "offline_scorer",
    rf"""WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents),
    labelled AS (SELECT doc_id, CASE WHEN lower(s) LIKE '%real%' OR lower(s) LIKE '%secur%' OR lower(s) LIKE '%hard%' THEN 'R0'
      WHEN lower(s) LIKE '%text%' OR lower(s) LIKE '%writ%' OR lower(s) LIKE '%doc%' THEN 'R1' ELSE 'R2' END AS label FROM s WHERE NOT regexp_full_match(s, '[{_SPACE}]*')),
    n AS (SELECT doc_id, count(*) AS n_tasks, count(*) FILTER (label = 'R1') AS n_r1, count(*) FILTER (label = 'R2') AS n_r2 FROM labelled GROUP BY doc_id)
    SELECT doc_id, CAST(iteration AS INT) AS iteration, n_tasks, n_r1, n_r2,
      CAST(round_even(CAST((n_r1 + n_r2 * 0.5) / n_tasks * 99 + 1 AS DECIMAL(18,9)), 1) AS DOUBLE) AS rho FROM n, (VALUES (1), (2)) AS i(iteration)""",
)
def offline_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scoring.supply_scores(scoring.run_scorer(docs, "doc_id", iterations=2).where("error IS NULL"), ["doc_id", "iteration"])


# --- vectors -------------------------------------------------------------------------------------------------------


_TOPK_SQL = """
sims AS (SELECT q.vec_id AS query_id, c.vec_id AS match_id, c.label,
    round_even(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
      / sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6) AS similarity
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS INT) AS rank FROM sims)"""


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The queries are the rows whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return matching.top_k(rows.where("vec_id % 100 = 0"), rows, k)


@query("cosine_topk", f"WITH {_TOPK_SQL} SELECT query_id, match_id, similarity, rank FROM ranked WHERE rank <= 5")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 5)


@query(
    "knn_label_vote",
    f"""WITH {_TOPK_SQL}, m AS (SELECT *, CASE label % 3 WHEN 0 THEN 'E0' WHEN 1 THEN 'E2' ELSE 'E1' END AS name, (label % 3) / 2.0 AS beta0 FROM ranked WHERE rank <= 5),
    s AS (SELECT query_id, sum(greatest(similarity, 0)) AS w, sum(greatest(similarity, 0) * beta0) AS wb, count(*) AS n, arg_min(beta0, rank) AS tb, arg_min(name, rank) AS tn, arg_min(similarity, rank) AS ts FROM m GROUP BY query_id),
    b AS (SELECT *, CASE WHEN w = 0 THEN tb ELSE wb / w END AS beta FROM s)
    SELECT query_id, CASE WHEN w = 0 THEN tn WHEN abs(beta) <= abs(beta - 0.5) AND abs(beta) <= abs(beta - 1) THEN 'E0' WHEN abs(beta - 0.5) <= abs(beta - 1) THEN 'E2' ELSE 'E1' END AS label,
      round_even(CAST(beta AS DOUBLE), 5) AS beta, CASE WHEN w = 0 THEN 1 ELSE n END AS n_matches_used, w = 0 OR ts < 0.5 AS low_confidence FROM b""",
)
def knn_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("E0"), F.lit("E2"), F.lit("E1")), F.col("label0") % 3 + 1)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("match_id"), F.col("label").alias("label0"))
    found = _nearest(spark, sf_dir, 5).join(labels, "match_id").withColumn("label", name).withColumn("beta", (F.col("label0") % 3) / 2.0)
    return matching.voted(found).withColumn("beta", F.bround("beta", 5))


# --- reliability and regression ------------------------------------------------------------------------------------


_ICC_SQL = """
WITH v AS (SELECT l_suppkey AS s, year(l_shipdate) AS r, avg(CAST(l_extendedprice AS DOUBLE)) AS v FROM lineitem GROUP BY ALL),
full_ AS (SELECT * FROM v WHERE s IN (SELECT s FROM v GROUP BY s HAVING count(*) = (SELECT count(DISTINCT r) FROM v))),
g AS (SELECT avg(v) AS g, count(DISTINCT s) AS n, count(DISTINCT r) AS k FROM full_),
ss AS (SELECT sum((m - g) ** 2) AS s FROM (SELECT avg(v) AS m FROM full_ GROUP BY s), g), rr AS (SELECT sum((m - g) ** 2) AS r FROM (SELECT avg(v) AS m FROM full_ GROUP BY r), g),
tt AS (SELECT sum((v - g) ** 2) AS t FROM full_, g),
ms AS (SELECT n, k, k * s / (n - 1) AS bms, n * r / (k - 1) AS jms, (t - k * s - n * r) / ((n - 1) * (k - 1)) AS ems FROM g, ss, rr, tt)
SELECT CAST(n AS BIGINT) AS n_subjects, CAST(k AS BIGINT) AS n_raters, round_even((bms - ems) / (bms + (k - 1) * ems + k / n * (jms - ems)), 6) AS icc, round_even(bms / ems, 6) AS f_statistic FROM ms"""


@query("icc_supplier_year", _ICC_SQL)
def icc_supplier_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("v"))
    one = reliability.point(reliability.squares(rows, "l_suppkey", "year", "v"))
    return one.select(F.col("n_subjects").cast("bigint").alias("n_subjects"), F.col("n_raters").cast("bigint").alias("n_raters"), F.bround("icc", 6).alias("icc"), F.bround("f_statistic", 6).alias("f_statistic"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A firm-quarter panel: log of shipments by supplier and quarter, and a score of the supplier."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm"), calendar.quarter_label(F.col("l_shipdate")).alias("quarter")).agg(F.sum(money("l_extendedprice")).alias("m"))
    return cells.withColumn("y", F.ln(F.col("m").cast("double"))).withColumn("score", (F.col("firm") * 7 % 11).cast("double"))


def _treated(rows: DataFrame, when) -> DataFrame:
    """x: the standardised score in the treated periods."""
    return regression.z_score(rows, "score", "z").withColumn("x", when.cast("double") * F.col("z"))


def _balanced(rows: DataFrame, columns: list[str]) -> DataFrame:
    return regression.balanced_within(rows.select("firm", "quarter", *columns), "firm", "quarter", columns)


_PANEL_SQL = """
panel AS (SELECT l_suppkey AS firm, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter, ln(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)) AS y,
  CAST(l_suppkey * 7 % 11 AS DOUBLE) AS score FROM lineitem GROUP BY ALL)"""


def _fe_sql(where: str, x: str, prefix: str = "") -> str:
    return f"""
{prefix}z AS (SELECT *, (score - avg(score) OVER ()) / stddev_samp(score) OVER () AS z FROM panel WHERE {where}),
{prefix}t AS (SELECT firm, quarter, y, CAST({x} AS DOUBLE) * z AS x FROM {prefix}z),
{prefix}d AS (SELECT firm, quarter, y - avg(y) OVER (PARTITION BY firm) - avg(y) OVER (PARTITION BY quarter) + avg(y) OVER () AS y,
  x - avg(x) OVER (PARTITION BY firm) - avg(x) OVER (PARTITION BY quarter) + avg(x) OVER () AS x FROM {prefix}t),
{prefix}b AS (SELECT sum(x * y) / sum(x * x) AS beta FROM {prefix}d),
{prefix}c AS (SELECT firm, sum(x * (y - beta * x)) AS score, sum(x * x) AS xx FROM {prefix}d, {prefix}b GROUP BY firm)"""


_POST = "quarter >= '1998Q4'"


@query(
    "fe_did_balanced",
    f"""WITH {_PANEL_SQL}, {_fe_sql("true", _POST)}, n AS (SELECT count(*) AS n, count(DISTINCT quarter) AS t FROM d)
    SELECT round_even(any_value(beta), 7) AS beta, round_even(sqrt(sum(score * score) * (count(*) / (count(*) - 1)) * (any_value(n) - 1) / (any_value(n) - any_value(t) - 1)) / sum(xx), 7) AS se,
      count(*) AS n_clusters, any_value(n) AS n_obs FROM c, b, n""",
)
def fe_did_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _balanced(_treated(_panel(spark, sf_dir), F.col("quarter") >= "1998Q4"), ["y", "x"])
    fit = regression.clustered_fit(rows, "firm", "quarter")
    return fit.withColumn("beta", F.bround("beta", 7)).withColumn("se", F.bround("se", 7))


@query("cluster_scores", f"WITH {_PANEL_SQL}, {_fe_sql('true', _POST)} SELECT firm, round_even(score, 6) + 0.0 AS score, round_even(xx, 6) AS xx FROM c")
def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _balanced(_treated(_panel(spark, sf_dir), F.col("quarter") >= "1998Q4"), ["y", "x"])
    return regression.cluster_scores(rows, "firm").select("firm", (F.bround("score", 6) + 0.0).alias("score"), F.bround("xx", 6).alias("xx"))


_BOOT_SQL = """
draws AS (SELECT draw, sum(CASE WHEN left(md5(firm || '-' || draw), 1) < '8' THEN 1 ELSE -1 END * score) / (SELECT sum(xx) FROM c) AS bb FROM c, range(1, 1000) r(draw) GROUP BY draw),
p AS (SELECT avg(CAST(abs(bb) >= abs(beta) AS DOUBLE)) AS p FROM draws, b)"""


def _p_value(rows: DataFrame) -> DataFrame:
    return regression.bootstrap_p(regression.cluster_scores(rows, "firm"), regression.slope(rows), "firm")


@query("wild_bootstrap_p", f"WITH {_PANEL_SQL}, {_fe_sql('true', _POST)}, {_BOOT_SQL} SELECT round_even(p, 6) AS p FROM p")
def wild_bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _balanced(_treated(_panel(spark, sf_dir), F.col("quarter") >= "1998Q4"), ["y", "x"])
    return _p_value(rows).select(F.bround("p", 6).alias("p"))


@query(
    "placebo_did",
    f"""WITH {_PANEL_SQL}, {_fe_sql("quarter < '1998Q4'", "quarter >= '1997Q2'")}, {_BOOT_SQL}
    SELECT round_even(beta, 7) AS beta, round_even(p, 6) AS p, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars FROM b, p""",
)
def placebo_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shock that wasn't, in the years before the real one."""
    early = _panel(spark, sf_dir).where("quarter < '1998Q4'")
    rows = _balanced(_treated(early, F.col("quarter") >= "1997Q2"), ["y", "x"])
    one = regression.slope(rows).join(F.broadcast(_p_value(rows)))
    return one.select(F.bround("beta", 7).alias("beta"), F.bround("p", 6).alias("p"), numbers.stars(F.col("p")).alias("stars"))


@query(
    "three_period_did",
    f"""WITH {_PANEL_SQL}, z AS (SELECT *, (score - avg(score) OVER ()) / stddev_samp(score) OVER () AS z FROM panel),
    t AS (SELECT firm, quarter, y, CAST(quarter >= '1998Q4' AND quarter < '2000Q1' AS DOUBLE) * z AS e, CAST(quarter >= '2000Q1' AS DOUBLE) * z AS a FROM z),
    d AS (SELECT y - avg(y) OVER (PARTITION BY firm) - avg(y) OVER (PARTITION BY quarter) + avg(y) OVER () AS y, e - avg(e) OVER (PARTITION BY firm) - avg(e) OVER (PARTITION BY quarter) + avg(e) OVER () AS e,
      a - avg(a) OVER (PARTITION BY firm) - avg(a) OVER (PARTITION BY quarter) + avg(a) OVER () AS a FROM t),
    s AS (SELECT sum(e * e) AS ee, sum(a * a) AS aa, sum(e * a) AS ea, sum(e * y) AS ey, sum(a * y) AS ay FROM d)
    SELECT round_even((ey * aa - ay * ea) / (ee * aa - ea * ea), 7) AS beta_early, round_even((ay * ee - ey * ea) / (ee * aa - ea * ea), 7) AS beta_advanced FROM s""",
)
def three_period_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regression.z_score(_panel(spark, sf_dir), "score", "z")
    late = F.col("quarter") >= "2000Q1"
    rows = rows.withColumn("e", ((F.col("quarter") >= "1998Q4") & ~late).cast("double") * F.col("z")).withColumn("a", late.cast("double") * F.col("z"))
    two = regression.two_slopes(_balanced(rows, ["y", "e", "a"]), "y", "e", "a")
    return two.select(F.bround("beta_early", 7).alias("beta_early"), F.bround("beta_advanced", 7).alias("beta_advanced"))


@query("significance_stars", "SELECT o_orderkey, o_totalprice / 1e6 AS p, CASE WHEN o_totalprice / 1e6 < 0.01 THEN '***' WHEN o_totalprice / 1e6 < 0.05 THEN '**' WHEN o_totalprice / 1e6 < 0.1 THEN '*' ELSE '' END AS stars FROM orders")
def significance_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice") / 1e6
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"), numbers.stars(p).alias("stars"))
