import math
import re
from collections import Counter

from orrery.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", "   \t\n", "one two", "a b c d e a b c d e f", "x " * 40, "é ü#|\nq\nq\n\nq\r\v w", "w1 " * 3 + "\f" + "k " * 9,
    " ".join(str(i % 300) for i in range(900)), " ".join(str(i) for i in range(3000)),
]


def test_metrics_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in quality.with_metrics(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    for n, k, p in ((50, 0, 0.1), (50, 3, 0.1), (4000, 5, 0.0025), (4000, 9, 0.0025)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-9)


def test_cutoffs_hold_their_risk(spark):
    good = "plain words of a clean text that goes on and on without end %d"
    bad = "#%%## $$$ ### &&& junk %d ### *** words$$$ here### now***"
    docs = [(i, (bad if i % 3 == 0 else good) % i, "en") for i in range(9000)] + [(9001, good % 1, None), (9002, None, "xx")]
    labels = [(i, int(i % 3 != 0)) for i in range(9000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(d, lab).collect()}
    assert all(kept[i] == (i % 3 != 0) for i in range(9000))
    assert kept[9001] and not kept[9002]
    same = {r.doc_id: r.kept for r in quality.quality_verdicts(d, lab).collect()}
    assert same == kept
    none = quality.quality_rules(d, lab.limit(0)).where("kept").count()
    assert none == 9001
    assert quality.quality_rules(d.limit(0), lab).count() == 0
