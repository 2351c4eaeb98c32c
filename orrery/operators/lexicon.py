"""Counts of lexicon terms in texts, leftmost and longest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

#: Fixed values: (pattern, category), as given.
TERMS = (
    ("generative AI", "core"),
    ("generative artificial intelligence", "core"),
    (r"\bLLM\b", "core"),
    (r"\bLLMs\b", "core"),
    ("large language model", "core"),
    ("large language models", "core"),
    ("foundation model", "core"),
    ("foundation models", "core"),
    ("ChatGPT", "named_product"),
    (r"\bGPT-[234]\b", "named_product"),
    (r"\bGPT\b", "named_product"),
    ("Claude", "named_product"),
    ("Gemini", "named_product"),
    ("Copilot", "named_product"),
    ("Llama", "named_product"),
    ("Mistral", "named_product"),
    ("prompt engineering", "technical"),
    ("retrieval augmented", "technical"),
    (r"\bRAG\b", "technical"),
    ("AI assistant", "technical"),
    ("AI copilot", "technical"),
    ("AI agent", "technical"),
)
CATEGORIES = ("core", "named_product", "technical")


def _length(pattern: str) -> int:
    """The length of what a pattern of literals, word ends and one-character classes matches."""
    import re

    return len(re.sub(r"\[[^]]*\]", "x", pattern.replace(r"\b", "")))


def matches(text: Column, terms=TERMS) -> Column:
    """The matched strings in order: at each place the longest term, none overlapping another."""
    ordered = sorted((p for p, _ in terms), key=lambda p: -_length(p))
    return F.regexp_extract_all(text, F.lit("(?iuU)" + "|".join(f"(?:{p})" for p in ordered)), F.lit(0))


def category_of(found: Column, terms=TERMS) -> Column:
    out = None
    for p, c in terms:
        hit = found.rlike(f"(?iuU)^(?:{p})$")
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out


def counted(docs: DataFrame, text_col: str = "text", terms=TERMS) -> DataFrame:
    """n_mentions_total and by category, filing_words, and mentions per thousand words; a null text has none."""
    found = F.transform(matches(F.coalesce(F.col(text_col), F.lit("")), terms), lambda x: category_of(x, terms))
    out = docs.withColumn("__found", found).withColumn("n_mentions_total", F.size("__found").cast("long"))
    for c in dict.fromkeys(c for _, c in terms):
        rest = F.array_remove("__found", c)
        out = out.withColumn(f"n_mentions_{c}", (F.size("__found") - F.size(rest)).cast("long"))
    words = word_count(F.col(text_col))
    density = F.col("n_mentions_total") / F.nullif(F.col("filing_words"), F.lit(0)) * 1000
    out = out.withColumn("filing_words", words).withColumn("mention_density", F.coalesce(F.bround(density, 4), F.lit(0.0)))
    return out.drop("__found")


def enumerated(submissions: DataFrame, forms: tuple[str, ...], start: str, end: str) -> DataFrame:
    """A row for each filing of the parallel arrays in ``recent`` whose form and date are wanted; short arrays give ''."""
    names = ["form", "filingDate", "accessionNumber", "primaryDocument", "reportDate"]
    zipped = F.arrays_zip(*[F.col(f"recent.{n}").alias(n) for n in names])
    rows = submissions.select("ticker", "cik", F.posexplode(zipped).alias("position", "f"))
    flat = rows.select("ticker", "cik", "position", *[F.coalesce(F.col("f").getField(n), F.lit("")).alias(n) for n in names])
    return flat.where(F.col("form").isin(*forms) & F.col("filingDate").between(start, end) & (F.col("accessionNumber") != ""))


def first_mentions(panel: DataFrame, key: str, order: list[str], count: str = "n_mentions_total") -> DataFrame:
    """Of each key the first row, by ``order``, that has a mention; the order must be total within a key."""
    from .facts import first_by

    return first_by(panel.where(F.col(count) > 0), [key], [F.col(c) for c in order])
