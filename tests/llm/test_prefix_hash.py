import hashlib
import random
from difflib import SequenceMatcher

import numpy as np
from orrery.llm import prefix_hash as ph


def P(t):
    return ph.Prefixes(ph.codes_of(t))


def test_span_equality_and_extensions_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 60)))
        b = a[rng.randrange(len(a)) :] + "".join(rng.choice("ab") for _ in range(20))
        x, y = P(a), P(b)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = min(len(a) - i, len(b) - j)
        want = next((k for k in range(n) if a[i + k] != b[j + k]), n)
        assert ph.extend(x, np.array([i]), y, np.array([j]))[0] == want
        m = min(i, j)
        want = next((k for k in range(m) if a[i - 1 - k] != b[j - 1 - k]), m)
        assert ph.extend_back(x, np.array([i]), y, np.array([j]))[0] == want


def test_likeness():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a = " ".join(word() for _ in range(400))
    b = " ".join(word() for _ in range(400))
    assert ph.likeness(P(a), P(a)) == 1 == ph.likeness(P(""), P(""))
    assert ph.likeness(P(a), P("")) == 0 and ph.likeness(P(a), P(b)) < 0.02
    moved = a[1000:] + a[:1000]
    inserted = a[:700] + " new words " + a[700:1500] + a[1600:]
    assert ph.likeness(P(a), P(moved)) > 0.95
    assert ph.likeness(P(a), P(inserted)) > 0.93
    assert abs(ph.likeness(P(a[:1000]), P(a[:750] + b[:250])) - 0.75) < 0.02
    assert P("ab").text() != P("ba").text() and P("a\0").text() != P("a").text()
    s, t = "short text", "short next"
    assert abs(ph.likeness(P(s), P(t)) - SequenceMatcher(None, s, t).ratio()) < 0.2


def test_query_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ph, "RANGES", 2)
    rng = random.Random(3)
    rows = [(i * 5, "".join(rng.choice("xyzé \n") for _ in range(rng.randrange(0, 90))), "c") for i in range(60)]
    rows += [(301, None, "c"), (302, "", "c"), (None, "null id", "c"), (295, "again", "c"), (295, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = ph.fingerprint_pairs(df).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t, _ in rows))
    assert len(got) == len(rows)
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), P(t).text(), P(e).text()))
    have = [
        (-1 if r.doc_id is None else r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), r.fingerprint, r.edited_fingerprint)
        for r in got
    ]
    assert sorted(have) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert ph.fingerprint_pairs(df.limit(0)).count() == 0
    one = ph.fingerprint_pairs(df.where("doc_id = 5")).first()
    assert one.near_next == 1
