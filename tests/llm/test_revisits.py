import random

import pytest
from orrery.llm import revisits
from pyspark.sql import functions as F

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string, status string"


@pytest.mark.parametrize(("spans", "hot"), [(1, 10_000), (7, 2), (128, 10_000)])
def test_matches_brute_force(spark, spans, hot):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        url = rng.choice(["http://a.b/x", "https://www.A.b/x/#f", "http://c.d/y?utm_source=z", None, "http://c.d/y"])
        kind = rng.choice(["response", "revisit", "revisit", None])
        ts = rng.choice([None, *range(40), 1 << 62, -(1 << 63), (1 << 63) - 1])
        tag, day = rng.choice(["t1", 'W/t1', "t2", None]), rng.choice(["d1", "d2", None])
        rows.append((i, url, ts, kind, tag, day, {"ETag": str(tag), "X": "s", "Date": str(i)}, f"c{i}", "clash"))
    canon = {"http://a.b/x": "a.b/x", "https://www.A.b/x/#f": "a.b/x", "http://c.d/y?utm_source=z": "c.d/y", "http://c.d/y": "c.d/y"}
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows + rows[:50], SCHEMA), spans, hot).collect()}
    bare = lambda t: t[2:] if t and t.startswith("W/") else t
    n = 0
    for i, url, ts, kind, tag, day, _, _, _ in rows:
        if kind != "revisit":
            assert i not in got
            continue
        n += 1
        old = [r for r in rows if r[3] == "response" and url and r[1] and canon[r[1]] == canon[url] and None not in (ts, r[2]) and r[2] < ts]
        old = max(old, key=lambda r: (r[2], r[0]), default=None)
        if old is None:
            want = "no_earlier_response"
        elif tag is None and day is None:
            want = "no_validator"
        else:
            ok = bare(tag) == bare(old[4]) if tag is not None else day == old[5]
            want = "resolved" if ok else "validator_mismatch"
        r = got[i]
        assert (r.status, r.refers_to) == (want, old[0] if want == "resolved" else None)
        if want == "resolved":
            assert r.digest == old[7] and r.headers == {"x": "s", "etag": str(tag), "date": str(i)}
    assert len(got) == n


def test_headers_and_urls(spark):
    old = F.create_map(F.lit("Vary"), F.lit("1"), F.lit("vary"), F.lit("2"), F.lit("A"), F.lit("3"))
    new = F.create_map(F.lit("VARY"), F.lit("4"), F.lit("b"), F.lit("5"))
    null = F.lit(None).cast("map<string,string>")
    got = spark.range(1).select(revisits.merged_headers(old, new), revisits.merged_headers(old, null), revisits.merged_headers(null, null)).first()
    assert tuple(got) == ({"a": "3", "vary": "4"}, {"vary": "2", "a": "3"}, {})
    for url, want in (("http://H:80/p/?a=1&utm_x=2&b=3#q", "h/p/?a=1&b=3"), ("https://h/p?ref=x", "h/p"), ("h", "h"), ("", "")):
        assert spark.range(1).select(revisits.canonical_url(F.lit(url))).first()[0] == want
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_record_ids_give_the_same_rows_in_any_order(spark):
    """Two responses of one id with other validators, two revisits of one id, and headers that differ."""
    rows = [
        (1, "a.b/x", 5, "response", "t1", None, {"Date": "1"}, "c1", None),
        (1, "a.b/x", 5, "response", "t2", None, {"Date": "2"}, "c2", None),
        (1, "a.b/x", 5, "response", "t2", None, {"Date": "3"}, "c2", None),
        (2, "a.b/x", 7, "revisit", "t2", None, {"Vary": "v"}, None, None),
        (2, "a.b/x", 9, "revisit", "t2", None, None, None, None),
        (2, "a.b/x", 3, "revisit", "t1", None, None, None, None),
        (3, "a.b/x", 8, "revisit", "t1", None, None, None, None),
    ]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, SCHEMA).repartition(len(order))
        for frame in (df, df.coalesce(1)):
            got = revisits.resolve(frame).select("record_id", "ts", "status", "refers_to", F.map_entries("headers").alias("h"), "digest").collect()
            seen.add(tuple(sorted((r.record_id, r.ts, r.status, str(r.refers_to), str(r.h), str(r.digest)) for r in got)))
    assert len(seen) == 1
    assert {r[:4] for r in seen.pop()} == {(2, 9, "resolved", "1"), (3, 8, "validator_mismatch", "None")}
