"""The dimension of firms: tiers, filters, and which filing to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import first_by

# Fixed values.
PRE_SHOCK_CUTOFF, MIN_PRE_SHOCK_QUARTERS = "2022-11-01", 6
EXCHANGES = ("NYSE", "NASDAQ", "NYSE AMERICAN", "NYSE MKT")
EXCLUDED = ("IIIV",)
CONSUMER_HINTS = (
    "match group", "bumble", "spotify", "dropbox", "grubhub", "shutterstock", "yelp", "zillow", "trivago", "cargurus",
    "angi homeservices", "angi inc", "iac/", "iac inc", "vimeo", "fiverr", "etsy", "wix.com", "godaddy",
    "electronic arts", "sports entertainment gaming", "motorsport games", "inspired entertainment",
)
SIC_TO_NAICS = {
    7370: "5415", 7371: "5415", 7372: "5112", 7373: "5415", 7374: "5182", 7375: "5191", 7376: "5415", 7377: "5415",
    7378: "5415", 7379: "5191", 2711: "5111", 2712: "5111", 2721: "5111", 2731: "5111", 2741: "5111", 8200: "6114",
    8220: "6113", 8221: "6113", 8244: "6114", 8249: "6114", 8299: "6114", 8742: "5416", 8748: "5416", 6199: "5239",
    6282: "5239", 6411: "5239", 6159: "5239", 7389: "5191",
}


def tier(in_software: Column, listed: Column) -> Column:
    """The tier of a firm from its industry and the tier that a list gives it; null for none."""
    return (
        F.when(in_software & F.coalesce(listed == "placebo", F.lit(False)), "placebo_both")
        .when(in_software, "primary_software")
        .when(listed.isin("primary_knowledge", "placebo"), listed)
    )


def tier_allowed(found: Column, wanted: str | None) -> Column:
    """Whether a tier passes the filter; placebo_both passes for primary_software."""
    if wanted is None:
        return F.lit(True)
    return (found == wanted) | (F.lit(wanted == "primary_software") & (found == "placebo_both"))


def consumer_flag(name: Column, hints: tuple[str, ...] = CONSUMER_HINTS) -> Column:
    low = F.lower(name)
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(low, h))


def naics(sic: Column, sector: Column) -> Column:
    """The mapped industry, or else the first four letters of the listed sector."""
    mapped = F.create_map(*[F.lit(x) for pair in SIC_TO_NAICS.items() for x in pair])
    return F.coalesce(F.try_element_at(mapped, sic), F.substring(sector, 1, 4), F.lit(""))


def universe(
    firms: DataFrame, listed: DataFrame, quarters: DataFrame, software_sic: list[int], wanted: str | None = None
) -> DataFrame:
    """Firms of a tier that trade on a known exchange, file annual reports and have enough quarters before the shock.

    firms: ticker, cik, company_name, sic, exchange, has_10k; listed: ticker, tier, sector, expected_rho; quarters: ticker, n.
    """
    known = listed.select("ticker", F.col("tier").alias("listed"), "sector", "expected_rho")
    software = F.coalesce(F.col("sic").isin(software_sic), F.lit(False))
    out = firms.join(known, "ticker", "left").withColumn("tier", tier(software, F.col("listed")))
    out = out.where(F.col("tier").isNotNull() & tier_allowed(F.col("tier"), wanted) & ~F.col("ticker").isin(*EXCLUDED))
    out = out.where(F.upper("exchange").isin(*EXCHANGES) & (~F.col("tier").isin("primary_knowledge", "placebo") | F.col("has_10k")))
    out = out.join(quarters.select("ticker", F.col("n").alias("n_pre_shock_quarters")), "ticker")
    return out.where(F.col("n_pre_shock_quarters") >= MIN_PRE_SHOCK_QUARTERS).select(
        "ticker", "cik", "company_name", "sic", naics(F.col("sic"), F.col("sector")).alias("naics"), "exchange", "tier",
        F.col("sector").alias("sector_code"), "expected_rho", "n_pre_shock_quarters",
        consumer_flag(F.col("company_name")).alias("consumer_flag"),
    )


def with_missing(found: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """found, and the listed rows whose key it lacks."""
    return found.unionByName(listed.join(found.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def latest_before(filings: DataFrame, key: str, day: str, cutoff: str, amended: Column, position: str) -> DataFrame:
    """Of each key the filing before the cutoff that comes first in its list; amended ones only where no other is."""
    early = filings.where(F.col(day) < F.lit(cutoff))
    return first_by(early, [key], [amended.cast("int"), F.col(position)])


def primary_document(items: DataFrame, key: str, form: str) -> DataFrame:
    """Of each filing index the main document: by type, else the largest page that is no exhibit or viewer, else any page."""
    name, kind = F.lower("name"), F.upper(F.coalesce("type", F.lit("")))
    page = name.rlike(r"\.html?$")
    plain = page & ~kind.startswith("EX") & ~name.rlike(r"^r\d+\.htm") & ~name.contains("ex-") & ~name.contains("index")
    rank = F.when(page & (kind == F.upper(F.lit(form))), 1).when(plain, 2).when(page, 3)
    ranked = items.withColumn("__rank", rank).where("__rank IS NOT NULL")
    size = F.coalesce(F.expr("try_cast(size AS BIGINT)"), F.lit(0))
    return first_by(ranked, [key], [F.col("__rank"), size.desc(), F.col("name")]).drop("__rank")


def without_placebo(firms: DataFrame, key: str = "ticker", skipped: str = "placebo") -> tuple[DataFrame, DataFrame]:
    """Firms to process, and (key, status, n_rows) records of those of the skipped tier, which have no rows."""
    gone = F.coalesce(F.col("tier") == skipped, F.lit(False))
    records = firms.where(gone).select(key, F.lit("skipped_placebo").alias("status"), F.lit(0).cast("long").alias("n_rows"))
    return firms.where(~gone), records


def first_listed(firms: DataFrame, position: str, n: int | None) -> DataFrame:
    """The first n firms of the list's order, all if n is None."""
    return firms if n is None else firms.orderBy(position).limit(n)


def report_dates(submissions: DataFrame, forms: tuple[str, ...], key: str = "ticker") -> DataFrame:
    """(key, first_10k_date, last_10k_date) among the parallel arrays ``form`` and ``filingDate``; null without such a report."""
    both = F.arrays_zip("form", "filingDate")
    dates = F.transform(F.filter(both, lambda x: x["form"].isin(*forms)), lambda x: F.to_date(x["filingDate"]))
    return submissions.select(key, F.array_min(dates).alias("first_10k_date"), F.array_max(dates).alias("last_10k_date"))
