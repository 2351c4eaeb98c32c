from orrery.llm import line_dedup
from pyspark.sql import functions as F


def test_drops_lines_over_the_ratio(spark, monkeypatch):
    rows = [(i, "a", f"menu \nbody {i}\n\n menu\nfoot {i % 2}", "c") for i in range(10)]
    rows += [(20, "b", "menu\nonly here", "c"), (21, None, "x\ny", "c"), (22, "b", None, "c"), (23, "a", "menu", "c"), (24, "b", "", "c")]
    rows += [(30 + i, None, "shared\n", "c") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string, n_lines string")
    for most, hot in ((100_000, 20_000), (0, 20_000), (0, 2)):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        monkeypatch.setattr(line_dedup, "HOT_PAGES", hot)
        got = {r.page_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df, "host").collect()}
        assert len(got) == len(rows)
        assert got[3] == ("body 3\n\nfoot 1", 4, 2)
        assert got[20] == ("menu\nonly here", 2, 0)
        assert got[23] == ("", 1, 1) and got[24] == ("", 0, 0) and got[22] == (None, 0, 0)
        assert got[21] == ("x\ny", 2, 0) and got[31] == ("", 1, 1)
    assert line_dedup.drop_boilerplate(df.limit(0), "host").count() == 0


def test_html(spark):
    df = spark.createDataFrame([("<p>a <b>b</b></p><script>x\n</script><li>c<!-- d -->", "HTTP://WWW.Ex.com:80/a?b"), (None, None)], "h string, u string")
    got = df.select(line_dedup.html_lines(F.col("h")), line_dedup.host_of(F.col("u"))).collect()
    assert tuple(got[0]) == ("\na b\nc\n", "ex.com") and tuple(got[1]) == (None, None)


def test_shared_passages_of_a_large_group(spark, monkeypatch):
    import corpus_pipeline

    body = lambda i: f"A line of document {i} that no other document has, with some more words on it."
    passage, license_, chance, rare = "Passage " + "of many words " * 10, "Licensed under the terms in LICENSE", "Yes.", "Rare " + "words " * 30
    rows = []
    for i in range(1000):
        lines = [body(i)] + [passage] * (i % 200 == 0) + [license_ + " "] * (i % 10 == 0) + [chance] * (i % 3 == 0) + [rare] * (i % 400 == 0) + ["Menu"]
        rows.append((i, "\n".join([*lines, "", f"end {i}"]), "en", "big", 0))
    copied = "\n".join(f"A copied document keeps all of its lines, here number {k} " + "x " * 40 for k in range(5))
    rows += [(2000 + i, copied, "en", "big", 0) for i in range(50)]
    rows += [(3000, None, "en", "big", 0), (3001, passage, "en", "small", 0), (3002, passage, "en", None, 0)]
    rows += [(4000 + i, f"{passage}\nnull {i}", "en", None, 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for most, hot in ((100_000, 20_000), (0, 20_000), (0, 2)):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        monkeypatch.setattr(line_dedup, "HOT_PAGES", hot)
        got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
        assert len(got) == len(rows) and got[3000] is None
        big = {k: (t or "").split("\n") for k, t in got.items() if k < 3000}
        with_line = lambda x: [k for k, t in big.items() if any(y.strip() == x.strip() for y in t)]
        assert len(with_line(passage)) == 1 and len(with_line(license_)) == 1 and not with_line("Menu")
        assert len(with_line(chance)) == 334 and len(with_line(rare)) == 3
        assert all(body(i) in big[i] and big[i][-2:] == ["", f"end {i}"] for i in range(1000))
        assert all(got[2000 + i] == copied for i in range(50))
        assert got[3001] == passage
        # Over half of a group: from all of it.
        assert got[3002] == "" and all(got[4000 + i] == f"null {i}" for i in range(6))


def test_hot_keys_are_dealt_out(spark):
    """One key, and null, with most of the rows: joined as any other, in several tasks."""
    from collections import Counter

    from orrery.llm.common import left_join_split

    rows = [(i, "hot" if i % 3 else None, {"a": str(i)}) for i in range(600)] + [(1000 + i, f"k{i}", None) for i in range(40)] + [(2000, "lost", None)]
    left = spark.createDataFrame(rows, "id long, k string, m map<string,string>")
    right = spark.createDataFrame([("hot", 1), (None, 2), *[(f"k{i}", 10 + i) for i in range(40)], ("unused", 3)], "rk string, v long")
    want = {i: None if k == "lost" else {"hot": 1, None: 2}.get(k, i - 990) for i, k, _ in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = left_join_split(left, right, [("k", "rk")], 25).withColumn("task", F.spark_partition_id())
        got = joined.collect()
        assert joined.columns == ["id", "k", "m", "rk", "v", "task"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.id: r.v for r in got} == want and len(got) == len(rows)
    assert max(Counter(r.task for r in got if r.k == "hot").values()) < 300
