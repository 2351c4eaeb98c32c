"""Panels of firms by quarter: stocks and flows, ratios, winsorizing, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import clipped, ratio
from .quantiles import exact_percentiles

# Fixed values.
LONGEST_GAP, COMPUTABLE = 120, 6
RATIOS = ("gross_margin", "rd_intensity", "sga_intensity", "sbc_intensity", "opex_ratio")
MARGIN_METRICS = ("revenue", "cogs", "rd", "sga", "sbc")


def gap_days(key: str, day: str) -> Column:
    """Days since the key's row before."""
    return F.datediff(F.col(day), F.lag(day).over(Window.partitionBy(key).orderBy(day)))


def billings(revenue: DataFrame, stock: DataFrame, key: str = "ticker", day: str = "period_end", longest: int = LONGEST_GAP) -> DataFrame:
    """Revenue plus the change of the stock since the revenue row before; null over a gap of more than ``longest`` days."""
    rows = revenue.join(stock, [key, day], "left")
    before = Window.partitionBy(key).orderBy(day)
    change = F.col("rpo_value") - F.lag("rpo_value").over(before)
    return (
        rows.withColumn("gap", gap_days(key, day))
        .withColumn("rpo_delta", F.when(F.col("gap") <= longest, change))
        .withColumn("billings", F.col("revenue") + F.col("rpo_delta"))
        .drop("gap")
    )


def billings_status(rows: DataFrame, key: str = "ticker", day: str = "period_end") -> DataFrame:
    """Of each key the computable quarters, the gaps among rows that have a stock, and a status."""
    gaps = rows.where("rpo_value IS NOT NULL").withColumn("gap", gap_days(key, day)).groupBy(key).agg(
        F.count_if(F.col("gap") > LONGEST_GAP).alias("n_gaps")
    )
    n = rows.groupBy(key).agg(F.count("billings").alias("n_billings"))
    status = F.when(F.col("n_billings") >= COMPUTABLE, "computable").when(F.col("n_billings") >= 1, "sparse").otherwise("none")
    return n.join(gaps, key, "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0))).withColumn("status", status)


def widened(long: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """A column for each metric of the list, null where the keys lack it; the first value that isn't null."""
    return long.groupBy(*keys).pivot("metric", list(names)).agg(F.first("value", ignorenulls=True))


def with_ratios(wide: DataFrame) -> DataFrame:
    r = F.col("revenue")
    return (
        wide.withColumn("gross_margin", ratio(r - F.col("cogs"), r))
        .withColumn("rd_intensity", ratio(F.col("rd"), r))
        .withColumn("sga_intensity", ratio(F.col("sga"), r))
        .withColumn("sbc_intensity", ratio(F.col("sbc"), r))
        .withColumn("opex_ratio", ratio(F.col("cogs") + F.col("rd") + F.col("sga"), r))
    )


def lengthened(wide: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """A row for each key and column of the list, nulls too."""
    return wide.unpivot(keys, list(names), "metric", "value")


def winsorized(long: DataFrame, low: float = 0.01, high: float = 0.99, group: str = "metric") -> DataFrame:
    """value_winsorized: the value within exact interpolated percentiles of its group."""
    clean = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    bounds = exact_percentiles(clean, group, "value", [low, high], "__b").withColumnRenamed(group, "__group")
    cut = clipped(F.col("value"), F.col("__b")[0], F.col("__b")[1])
    # A row for each group with a value; rows of other groups have nothing to cut.
    return clean.join(bounds, F.col(group).eqNullSafe(F.col("__group")), "left").withColumn("value_winsorized", cut).drop("__b", "__group")


def margin_panel(long: DataFrame, keys: list[str]) -> DataFrame:
    return winsorized(lengthened(with_ratios(widened(long, keys, MARGIN_METRICS)), keys, RATIOS))


def upserted(existing: DataFrame, new: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """existing without the rows of the touched keys (those of ``new`` if none are given), and new."""
    touched = new.select(*keys).distinct() if touched is None else touched.select(*keys).distinct()
    return existing.join(touched, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_rows(rows: DataFrame, key: str, order: str, k: int = 12) -> DataFrame:
    """Of each key the last k rows by ``order``, which must be different within a key; nulls come before all others."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last()))
    return rows.withColumn("__n", n).where(F.col("__n") <= k).drop("__n")


def carried_over(requested: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requested keys that aren't done."""
    return requested.join(done.select(key).distinct(), key, "left_anti")


def to_process(status: Column, there: Column, permanent: tuple[str, ...], failed: tuple[str, ...], named: bool = False, skip: bool = True, retry: bool = False) -> Column:
    """Whether a key is to be processed: named ones always, permanent failures never, new ones always, else by the flags."""
    if named:
        return F.lit(True)
    again = F.coalesce(status.isin(*failed), F.lit(False)) if retry else F.lit(False)
    return F.when(F.coalesce(status.isin(*permanent), F.lit(False)), False).when(~there, True).otherwise(again if skip else F.lit(True))
