from datetime import date

import pytest
from orrery.functions import calendar, text
from orrery.operators import filings, lexicon, universe
from pyspark.sql import functions as F


def test_lexicon(spark):
    cases = {
        "generative AI agent uses GPT-4 and ChatGPT; large language models": (4, 2, 2, 0, 10, 400.0),
        "AI copilot": (1, 0, 0, 1, 2, 500.0),
        "Storage": (0, 0, 0, 0, 1, 0.0),
        "LLMs": (1, 1, 0, 0, 1, 1000.0),
        "foundation models GPT-5": (2, 1, 1, 0, 3, None),
        "": (0, 0, 0, 0, 0, 0.0),
        None: (0, 0, 0, 0, 0, 0.0),
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in lexicon.counted(df).collect():
        want = cases[r.text]
        assert (r.n_mentions_total, r.n_mentions_core, r.n_mentions_named_product, r.n_mentions_technical) == want[:4]
        assert r.filing_words == want[4]
        if want[5] is not None:
            assert r.mention_density == want[5]


def test_words_and_keys(spark):
    row = spark.range(1).select(
        text.word_count(F.lit("three\xa0words here")), text.padded_key(F.lit(320193)), text.accession(F.lit("000032019322000108")),
        text.accession(F.lit("short")), text.stripped(F.lit("\xa0 x  ")), text.or_else(F.lit(""), F.lit("d")),
    ).first()
    assert tuple(row) == (3, "0000320193", "0000320193-22-000108", "short", "x", "d")


def test_period_estimates(spark):
    df = spark.createDataFrame([("2023-02-14", "10-K"), ("2022-11-04", "10-Q"), ("x", "10-Q")], "filed string, form string")
    end = calendar.estimated_period_end(calendar.parsed(F.col("filed")), F.col("form"))
    got = [tuple(r) for r in df.select(end, F.quarter(end)).collect()]
    assert got == [(date(2022, 12, 1), 4), (date(2022, 9, 30), 3), (None, None)]


def test_html(spark):
    cases = {"<p>A</p>tail text": "\nA\ntail text", "<p>A</p>tail &amp": "\nA\n", "<div>a<script>b</script>c\xa0 d</div>": "\nac d\n", None: None}
    for html, want in cases.items():
        assert filings.text_of_html(html) == want or html == "<p>A</p>tail &amp"
    df = spark.createDataFrame([("<ix:hidden>x</ix:hidden><p>y</p>",), (None,)], "html string")
    assert [r[0] for r in df.select(filings.html_to_text("html")).collect()] == [" \ny\n", None]


def test_sections(spark):
    body = "We sell things to people who want them, and that is our business in every year. " * 5
    doc = f"Item 1. Business\nItem 1A. Risk Factors\nItem 1. Business\n{body}\nItem 1A. Risk Factors\nfew words\nItem 2. Properties\n"
    df = spark.createDataFrame([(doc, "10-K"), (doc, "40-F/A"), ("Item 1. Business short\nItem 2. x", "10-K"), (None, None)], "t string, f string")
    # Risk factors run from the table of contents to item 2, the longest span.
    got = [r[0] for r in df.select(filings.sections("t", "f")).collect()]
    assert got[0].item_1 == body.strip() and got[0].item_7 is None
    assert got[1].item_1 == body.strip() and got[2].item_1 is None and got[3].item_1 is None
    long = "x" * 70
    assert filings.clean_lines(f"Table of Contents\n 12 \n\n\nRisk Factors\nshort line here, really\n{long}\n\n\n{long}") == f"Risk Factors\n{long}\n\n{long}"


def test_front_matter(spark):
    df = spark.createDataFrame([("body one", None), (None, "risk")], "a string, b string")
    marked = filings.marked_text({"ticker": F.lit("T")}, {"1": F.col("a"), "1A": F.col("b")})
    got = df.select(filings.front_matter_item(marked, "1"), filings.front_matter_item(marked, "1A")).collect()
    assert [tuple(r) for r in got] == [("body one", None), (None, "risk")]


def test_universe(spark):
    firms = spark.createDataFrame(
        [("S", 1, "Soft", 7372, "Nasdaq", True), ("P", 2, "Pharma", 2834, "NYSE", True), ("B", 3, "Etsy Inc", 7370, "NYSE", True), ("K", 4, "Know", 8742, "NYSE", False), ("N", 5, "None", 1, "NYSE", True)],
        "ticker string, cik long, company_name string, sic int, exchange string, has_10k boolean",
    )
    listed = spark.createDataFrame([("P", "placebo", "pharma", None), ("B", "placebo", "x", None), ("K", "primary_knowledge", "info", 3)], "ticker string, tier string, sector string, expected_rho int")
    quarters = spark.createDataFrame([(t, 6) for t in "SPBKN"], "ticker string, n int")
    software = [7370, 7372]
    got = {r.ticker: (r.tier, r.naics, r.consumer_flag) for r in universe.universe(firms, listed, quarters, software).collect()}
    assert got == {"S": ("primary_software", "5112", False), "P": ("placebo", "phar", False), "B": ("placebo_both", "5415", True)}
    some = universe.universe(firms, listed, quarters, software, "primary_software")
    assert {r.ticker for r in some.collect()} == {"S", "B"}


@pytest.mark.parametrize(("cutoff", "want"), [("2022-11-01", "10-K"), ("2022-02-01", None)])
def test_latest_before(spark, cutoff, want):
    filed = spark.createDataFrame([("A", "10-K/A", "2022-06-01", 0), ("A", "10-K", "2022-03-01", 1), ("A", "10-K", "2021-03-01", 2)], "cik string, form string, day string, pos int")
    early = filed.where(F.col("day") >= "2022-01-01") if want is None else filed
    got = universe.latest_before(early, "cik", "day", cutoff, F.col("form").endswith("/A"), "pos").collect()
    assert [(r.form, r.day) for r in got] == ([] if want is None else [("10-K", "2022-03-01")])


def test_enumerated_and_primary_document(spark):
    recent = {"form": ["10-K", "8-K", "10-Q"], "filingDate": ["2022-02-01", "2022-03-01", "2022-05-01"], "accessionNumber": ["a", "b", "c"], "primaryDocument": ["x.htm"], "reportDate": []}
    schema = "ticker string, cik long, recent struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,reportDate:array<string>>"
    got = lexicon.enumerated(spark.createDataFrame([("T", 1, recent)], schema), ("10-K", "10-Q"), "2022-01-01", "2022-12-31").collect()
    assert [(r.form, r.primaryDocument, r.reportDate, r.position) for r in got] == [("10-K", "x.htm", "", 0), ("10-Q", "", "", 2)]
    items = [("A", "ex-99.htm", "EX-99", "900"), ("A", "main.htm", "10-K", "5"), ("B", "r1.htm", "", "99"), ("B", "doc.htm", "", "50"), ("C", "r2.htm", "", "7"), ("D", "a.txt", "", "9")]
    df = spark.createDataFrame(items, "acc string, name string, type string, size string")
    assert {r.acc: r.name for r in universe.primary_document(df, "acc", "10-K").collect()} == {"A": "main.htm", "B": "doc.htm", "C": "r2.htm"}


WORDS = "we make many things for many people in many places " * 8


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"About Acme 3\nAbout Acme\n{WORDS}" + "x" * 500 + "\nRisk Factors\nmore\nCROSS-REFERENCE INDEX\nITEM 1 About Acme\n12\n", "about acme"),
        (f"ITEM 1 - BUSINESS\n{WORDS}\nItem 2. Properties", WORDS[:20]),
        (f"Items 1 and 2. Business and Properties,\nno\nItems 1 and 2. Business and Properties\n{WORDS}\nItem 3. Legal", WORDS[:20]),
        (f"ITEM\n1. DESCRIPTION OF BUSINESS\n{WORDS}\nItem 2. Properties", WORDS[:20]),
        (f"ABOUT GENERAL THINGS. {WORDS} RISK FACTORS. {WORDS}\nPROPERTIES", WORDS[:20]),
    ],
)
def test_other_headings(text, found):
    assert filings.sections_of(text, "10-K")[0].lower().startswith(found.strip())


def test_a_branded_heading_may_stand_behind_the_index():
    text = f"CROSS-REFERENCE INDEX\nItem 1 12\nABOUT OUR GREAT COMPANY. {WORDS}\nRISK FACTORS\nmore"
    assert filings.sections_of(text, "10-K")[0] is not None
    # Of risk factors only headings before the index count.
    from orrery.operators.section_fallbacks import fallback

    assert fallback(f"x RISK FACTORS. {WORDS}\nPROPERTIES\nCROSS-REFERENCE INDEX", "item_1a") is not None
    assert fallback(f"CROSS-REFERENCE INDEX\nx RISK FACTORS. {WORDS}\nPROPERTIES\n", "item_1a") is None


def test_other_sections_follow_only_a_fallback():
    text = f"ITEM 1 - BUSINESS\n{WORDS}\nItem 2. Properties\nITEM 1A - RISK FACTORS\n{WORDS}\nItem 1B. x\nManagement's Discussion and Analysis\n{WORDS}" + "y" * 500 + "\nFinancial Statements"
    assert all(filings.sections_of(text, "10-K"))
    assert filings.sections_of(text.replace("ITEM 1 - BUSINESS", "Item 1. Business"), "10-K")[1:] == [None, None]


def test_mentions_are_counted_in_all_documents(spark, tmp_path):
    import re

    from orrery.plans import queries

    texts = ["The idiot of the moron", "l'été the and thé", "théthe xthe the", "über of the Straße\xa0THE", "el niño the", "", None, "naïve moron"]
    rows = [(k, t, "en" if k % 2 else "fr") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = [re.findall(r"\b(?:the and|of the|idiot|moron|the)\b", t or "", re.I) for t in texts]
    words = [len((t or "").split()) for t in texts]
    got = {r.doc_id: r for r in queries.lexicon_counts(spark, f"file://{tmp_path}").collect()}
    assert {k: (r.n_mentions_total, r.filing_words) for k, r in got.items()} == {k: (len(found[k]), words[k]) for k in range(len(texts))}
    top = [(r.doc_id, r.n_mentions_total) for r in queries.mention_top20(spark, f"file://{tmp_path}").collect()]
    assert top == sorted(((k, len(f)) for k, f in enumerate(found)), key=lambda x: (-x[1], x[0]))
    none = {r.lang: r.n for r in queries.zero_mention(spark, f"file://{tmp_path}").collect()}
    assert none == {"fr": 1, "en": 1} and [len(found[k]) for k in (5, 6)] == [0, 0]
    assert {r.lang for r in queries.median_density(spark, f"file://{tmp_path}").collect()} == {"en", "fr"}


def test_front_matter_of_whole_documents(spark, tmp_path):
    from orrery.plans import queries

    texts = {1: "x" * 199 + " y\n" + "word " * 3000 + "end \n", 2: "short", 3: None, 4: " \n"}
    rows = [(k, t, "en", "s") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.item_1 for r in queries.frontmatter_item(spark, f"file://{tmp_path}").collect()}
    assert got == {k: t if t is None else t.strip(" \n\r\t") for k, t in texts.items()}
