import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from orrery.llm import lexical_search as search


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x for *_, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    for i, ts in asked.items():
        rows = []
        for d, c, size in counted:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in ts if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    common = ["the", "a", "of", "é", "x1"]
    rare = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(500):
        words = [rng.choice(common) if rng.random() < 0.6 else rare[int(300 * rng.random() ** 3)] for _ in range(rng.choice([1, 5, 40, 200]))]
        docs.append((i % 450, rng.choice([" ", ", ", "\n"]).join(words).title()))
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, None), (8, ""), (9, "... !"), (900, "w5 " * 3000), (901, "W5 The")]
    items = [(j, " ".join(rng.choice(rare[:60] + common) for _ in range(25))) for j in range(12)]
    return docs, [*items, (3, "w5 w5"), (50, "nowhere"), (51, None), (None, "w1 the"), (52, "The the THE w299")]


@pytest.mark.parametrize("size,block,seeds,piece", [(16 << 20, 128, 16, 4 << 20), (4000, 2, 3, 50), (1, 4, 5, 7)])
def test_ranked_is_that_of_all_documents(spark, monkeypatch, size, block, seeds, piece):
    for name, value in (("SHARD_BYTES", size), ("BLOCK", block), ("SEEDS", seeds), ("PIECE", piece), ("QUERY_BYTES", 600)):
        monkeypatch.setattr(search, name, value)
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = search.ranked(d, q, 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 20)


def test_bounds_reject_blocks_before_they_are_decoded(monkeypatch):
    """With a threshold that only a few documents reach, a long list is not decoded, and the best are all the same."""
    made = search._Builder(4, 1 << 20)
    for i in range(400):
        made.add(i, "common " * (1 + i % 3) + ("rare rare" if i % 97 == 0 else "other"))
    corpus = search.Corpus(400, sum(made.lens))
    row = made.row(0)
    read = []
    whole = search.Shard(row, corpus, {b"common", b"rare"})
    raw = whole._raw
    monkeypatch.setattr(whole, "_raw", lambda name, k, s, e: read.append((name, k, s, e)) or raw(name, k, s, e))
    query = [(b"common", 3), (b"rare", 4000)]
    docs, scores = search.Shard(row, corpus, {b"common", b"rare"}).best(query, 0)
    assert len(docs) == 400
    top = int(np.sort(scores)[-3])
    some, theirs = whole.best(query, top)
    assert set(docs[scores >= top]) <= set(some) and (theirs[np.isin(some, docs[scores >= top])] >= top).all()
    common = whole.place[b"common"]
    assert sum(e - s for name, k, s, e in read if k == common and name == "gap") <= 4 * 5


def test_long_products():
    c = search.Corpus(10**12, 10**15)
    lens = np.array([3, 10**9])
    assert c.m(lens).tolist() == [75 + int(n) * 25 * 10**12 // 10**15 for n in lens]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked(none, items).count() == 0
    assert search.ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
    got = search.ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).collect()
    assert [tuple(r)[:3] for r in got] == [(1, 1, 1)]
