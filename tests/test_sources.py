import json

import pytest
from orrery.operators import facts
from orrery.sources import tables


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("B", 1, None, 1, 2022, "m", 2.5), ("A", 2, None, 1, 2022, "m", None)], tables.SCHEMAS["financial"])
    tables.write_sorted_csv(df, f"file://{tmp_path}/c", ["ticker"])
    back = tables.read_csv(spark, f"file://{tmp_path}/c", "financial", columns=["ticker", "value"])
    assert [tuple(r) for r in back.collect()] == [("A", None), ("B", 2.5)]
    with pytest.raises(ValueError, match="missing columns: x"):
        tables.require(back, ["ticker", "x"])


def test_json_sources(spark, tmp_path):
    entry = {"end": "2022-03-31", "val": 3.0, "fp": "Q1", "form": "10-Q", "filed": "2022-05-01"}
    (tmp_path / "a.json").write_text(json.dumps({"ticker": "A", "cik": 1, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [entry]}}}}}))
    (tmp_path / "b.json").write_text("{broken")
    rows = tables.read_facts(spark, f"file://{tmp_path}").cache()
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1
    assert facts.entries(rows.where("ticker IS NOT NULL")).first().val == 3.0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "dir.json").write_text(json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [["1", "N", "T", "NYSE"], ["1", "N", "T.B", "NYSE"], ["2", "M", "U", None]]}))
    got = {tuple(r) for r in tables.read_directory(spark, f"file://{tmp_path}/d").collect()}
    assert got == {(1, "N", "T", "NYSE"), (2, "M", "U", None)}


def test_landing_and_upsert(spark, tmp_path):
    path, calls = f"file://{tmp_path}/l", []

    def fetch(keys):
        found = [r.k for r in keys.collect()]
        calls.append(sorted(found))
        return spark.createDataFrame([(k, k * 10) for k in found], "k int, v int")

    ask = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    tables.land_missing(spark, ask(1, 2), path, "k", fetch)
    got = tables.land_missing(spark, ask(2, 3), path, "k", fetch)
    assert {tuple(r) for r in got.collect()} == {(2, 20), (3, 30)} and calls == [[1, 2], [3]]
    tables.upsert_parquet(spark.createDataFrame([(1, 5)], "k int, v int"), path, ["k"], f"file://{tmp_path}/u")
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/u").collect()} == {(1, 5), (2, 20), (3, 30)}
    with pytest.raises(ValueError, match="at once"):
        tables.upsert_parquet(got, path, ["k"], path)
    tables.write_lines(got, f"file://{tmp_path}/j")
    assert spark.read.text(f"file://{tmp_path}/j").count() == 2


def test_missing_and_broken_files_have_a_status(spark, tmp_path):
    (tmp_path / "AA.json").write_text(json.dumps({"ticker": "AA", "cik": 1, "facts": {}}))
    (tmp_path / "BB.json").write_text("{broken")
    asked = spark.createDataFrame([("AA",), ("BB",), ("CC",), (None,)], "ticker string")
    found = tables.facts_status(asked, tables.read_facts(spark, f"file://{tmp_path}"))
    assert {r.ticker: r.status for r in found.collect()} == {"AA": "ok", "BB": "cache_read_error", "CC": "no_cache", None: "no_cache"}


def test_index_columns_and_appended_rows(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("\ttask\tbeta\n0\tread\t0.5\n1\twrite\t\n")
    rows = tables.read_csv(spark, f"file://{tmp_path}/t.tsv", "task string, beta double", sep="\t", index=True)
    assert rows.columns == ["task", "beta"] and {tuple(r) for r in rows.collect()} == {("read", 0.5), ("write", None)}
    for k in (1, 2):
        tables.append_csv(spark.createDataFrame([(k, f"v{k}")], "k int, v string"), f"file://{tmp_path}/a")
    back = tables.read_csv(spark, f"file://{tmp_path}/a", "k int, v string")
    assert {tuple(r) for r in back.collect()} == {(1, "v1"), (2, "v2")}


def test_records_are_replaced_whole_and_merged_by_key(spark, tmp_path):
    path, schema = f"file://{tmp_path}/qa", "ticker string, status string"
    tables.merge_records(spark.createDataFrame([("A", "failed"), ("B", "ok")], schema), path, "ticker")
    tables.merge_records(spark.createDataFrame([("A", "ok"), ("C", "ok")], schema), path, "ticker")
    assert {tuple(r) for r in tables.read_records(spark, path, schema).collect()} == {("A", "ok"), ("B", "ok"), ("C", "ok")}
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["qa"]
    plain = f"file://{tmp_path}/plain"
    spark.createDataFrame([("A", "old"), ("D", "old")], schema).write.json(plain)
    tables.merge_records(spark.createDataFrame([("A", "new")], schema), plain, "ticker")
    assert {tuple(r) for r in tables.read_records(spark, plain, schema).collect()} == {("A", "new"), ("D", "old")}


def test_marked_texts_are_written_by_key(spark, tmp_path):
    from orrery.operators import filings
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("A", "body one\nand two"), ("B", None)], "ticker string, body string")
    df = df.withColumn("text", filings.marked_text({"ticker": F.col("ticker")}, {"1": F.col("body")}))
    tables.write_marked(df, f"file://{tmp_path}/m", "ticker")
    back = tables.read_texts(spark, f"file://{tmp_path}/m/*/*.txt").select("path", filings.front_matter_item(F.col("text"), "1").alias("item"))
    assert {(r.path.split("ticker=")[1][0], r.item) for r in back.collect()} == {("A", "body one\nand two"), ("B", None)}


def test_configurations(spark, tmp_path):
    from orrery.operators import lexicon

    (tmp_path / "c.yaml").write_text(
        "inclusion_terms:\n  - pattern: \"\\\\bLLM\\\\b\"\n    category: core\n  - {pattern: Gemini, category: named_product}\n"
        "placebo_tickers:\n  - {ticker: X, sector: food, expected_rho: 5, company: Xco}\nprimary_knowledge_tickers:\n  - {ticker: Y, sector: info}\n  - {ticker: X}\n"
        "tiers:\n  primary_software: {sic_codes: [7370, 7372]}\nexchanges: [NYSE, Nasdaq]\nmin_pre_shock_quarters: 6\nexclusions:\n  - {ticker: Z, reason: r}\n"
    )
    found = tables.read_config(str(tmp_path / "c.yaml"))
    docs = spark.createDataFrame([(1, "An LLM and Gemini, LLMs")], "k int, text string")
    r = lexicon.counted(docs, "text", tables.lexicon_terms(found)).first()
    assert (r.n_mentions_total, r.n_mentions_core, r.n_mentions_named_product) == (2, 1, 1)
    listed = {tuple(x) for x in tables.listed_tickers(spark, found).collect()}
    assert listed == {("X", "placebo", "food", 5, "Xco"), ("Y", "primary_knowledge", "info", None, None)}
    assert tables.universe_rules(found) == {"software_sic": [7370, 7372], "exchanges": ("NYSE", "NASDAQ"), "min_quarters": 6, "excluded": ("Z",)}
    (tmp_path / "bad.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="no mapping"):
        tables.read_config(str(tmp_path / "bad.yaml"))


def test_requests_wait_and_try_again(spark):
    from orrery.sources import web

    def run(answers):
        waited, left = [], list(answers)

        def transport(url):
            found = left.pop(0)
            if isinstance(found, Exception):
                raise found
            return found

        return web.get("u", transport, sleep=waited.append), waited, len(left)

    assert run([(200, b"x")]) == (b"x", [], 0)
    assert run([(429, b""), (503, b""), (200, b"x")]) == (b"x", [2.0, 8.0], 0)
    assert run([(404, b""), (200, b"x")]) == (None, [], 1)
    assert run([ConnectionError("lost"), (200, b"y")]) == (b"y", [2.0], 0)
    assert run([(500, b"")] * 4) == (None, [2.0, 8.0, 32.0], 0)
    urls = spark.createDataFrame([(1, "a"), (2, "missing"), (3, None)], "k int, url string")
    got = web.fetched(urls, lambda u: (200, u.encode()) if u == "a" else (404, b""), sleep=lambda s: None)
    assert {r.k: r.body and bytes(r.body) for r in got.collect()} == {1: b"a", 2: None, 3: None}
    assert web.fetched(urls.limit(0), lambda u: (200, b""), sleep=lambda s: None).count() == 0


def test_older_pages_follow_the_recent_arrays(spark):
    from orrery.sources import web

    recent = spark.createDataFrame([(1, ["a"], ["d1"]), (2, [], None)], "cik int, form array<string>, filingDate array<string>")
    pages = spark.createDataFrame([(1, 2, ["c"], None), (1, 1, ["b", "b2"], ["d2", "d3"]), (3, 1, ["lost"], ["d"])], "cik int, page int, form array<string>, filingDate array<string>")
    got = {r.cik: (r.form, r.filingDate) for r in web.merged_pages(recent, pages, "cik", ["form", "filingDate"]).collect()}
    assert got == {1: (["a", "b", "b2", "c"], ["d1", "d2", "d3"]), 2: ([], [])}
