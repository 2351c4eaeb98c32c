import random
import re

import pytest
from orrery.llm import licenses
from pyspark.sql import functions as F

RULES = [
    licenses.Rule(0, "mit", "mit", "under the mit license"),
    licenses.Rule(1, "tag", "spdx", "spdx (?:id )?[a-z]+"),
    licenses.Rule(2, "mit", "mit", "mit license(?: text)?"),
    licenses.Rule(2, "twin", "mit", "mit license"),
    licenses.Rule(2, "wide", "the", "the (?:[a-z]+ ){0,3}license"),
    licenses.Rule(3, "hint", "license", "license"),
]


def brute(text, rules):
    """Detections by places of words, and suppression by all pairs."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for k, r in enumerate(rules):
        if r.keyword not in words:
            continue
        at = 0
        while at < len(words):
            # The match at this word that a left-to-right regex takes, if any.
            m = re.match(rf"(?:{r.regex})(?= |$)", " ".join(words[at:]))
            if m:
                n = m.group().count(" ") + 1
                found.append((at, at + n - 1, r.priority, k, r.label))
                at += n
            else:
                at += 1
    out = []
    for a in found:
        over = any(
            b[2] <= a[2] and b[0] <= a[0] and b[1] >= a[1] and (b[1] - b[0] > a[1] - a[0] or b[2] < a[2] or b[3] < a[3]) for b in found if b != a
        )
        out.append((*a, a[2] == 0 or not over))
    return len(words), sorted(out, key=lambda d: (d[0], -d[1], d[2], d[3]))


def texts():
    rng = random.Random(5)
    some = ["under", "the", "MIT", "license", "text", "SPDX", "id", "é", "mit-license", "K", "a", "\x1f", "apache"]
    out = [" ".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(120)]
    return [*out, None, "", "...", "under the mit license", "mit license " * 700 + "K", "İmit license", "under the mit licenses"]


@pytest.mark.parametrize("chunk", [3, 256])
def test_scan_is_that_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(licenses, "CHUNK", chunk)
    rows = [(i if i % 7 else None, t, 5, "x") for i, t in enumerate(texts())]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, Detections string").repartition(3)
    got = licenses.scan(df, rules=RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        n, want = brute(r["text"], RULES)
        assert r["n_words"] == n
        assert [tuple(d) for d in r["detections"]] == want


def test_digest(spark):
    df = spark.createDataFrame([(1, "License: under the MIT license; x, under the MIT license."), (2, None), (3, "spdx id mit")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(df, rules=RULES)).collect()}
    a = got[1]
    assert (a["n_base"], a["first_word"], a["last_word"], a["base_labels"], a["labels"], a["score"]) == (2, 1, 6, "mit", "hint,mit", 1.0)
    b = got[2]
    assert (b["n_words"], b["n_base"], b["first_word"], b["last_word"], b["base_labels"], b["labels"], b["score"]) == (0, 0, None, None, "", "", 0.0)
    assert got[3]["labels"] == "tag" and got[3]["n_base"] == 0


def test_every_rule_is_gated_by_a_word_of_its_matches():
    """The plainest text that a rule matches holds the rule's keyword."""
    rules = licenses.parsed()
    assert len(rules) > 250
    for r in rules:
        # Groups that must match become their first choice, from within; then optional ones go.
        plain = re.sub(r"\(\?:([^()|]*)[^()]*\)(?![?{])", r"\1", r.regex)
        plain = re.sub(r"\(\?:[^()]*\)(?:\?|\{0,6\})", "", plain)
        plain = re.sub(r"\[\^ \]\+", "x", re.sub(r"\[(.)[^\]]*\]", r"\1", plain))
        plain = re.sub(r".\?", "", plain)
        assert re.fullmatch(r.regex, plain), (r, plain)
        assert r.keyword in plain.split(), (r, plain)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.digest(licenses.scan(df)).count() == 0


def test_running(spark):
    df = spark.createDataFrame([([],), (list(range(1, 11)),)], "v array<int>")
    got = df.select(licenses.running(F.col("v"), F.lit(0), lambda a, b: a + b, 3).alias("r")).collect()
    assert [r["r"] for r in got] == [[], [1, 3, 6, 10, 15, 21, 28, 36, 45, 55]]
