"""Calendar periods of filings and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days between a report's filing and the end of its period, by kind of form.
ANNUAL_LAG, QUARTERLY_LAG = 75, 35


def parsed(text: Column) -> Column:
    """A date of YYYY-MM-DD, null if it isn't one."""
    return F.try_to_date(text.cast("string"), "yyyy-MM-dd")


def quarter_label(day: Column) -> Column:
    """Calendar quarter, as 2022Q4."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def estimated_period_end(filed: Column, form: Column) -> Column:
    """The likely end of the period of a report that doesn't say it."""
    return F.date_sub(filed, F.when(form.contains("10-K"), ANNUAL_LAG).otherwise(QUARTERLY_LAG))


def period_dummies(day: Column, shock: str, advanced: str) -> dict[str, Column]:
    """Whether a day is after the shock, and in its early or advanced part."""
    post, late = day >= F.lit(shock).cast("date"), day >= F.lit(advanced).cast("date")
    return {"post": post.cast("int"), "early": (post & ~late).cast("int"), "advanced": late.cast("int")}
