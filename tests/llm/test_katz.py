import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from orrery.llm import katz


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]  # None: the end


class Brute:
    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = tokens_of(t)
            self.c1.update(w)
            self.c2.update(zip([0, *w[:-1]], w, strict=True))
        self.ch = Counter()
        for (h, _), c in self.c2.items():
            self.ch[h] += c
        self.n = sum(self.c1.values())
        of = lambda c: [0, *[sum(v == r for v in c.values()) for r in range(1, katz.CUT + 2)]]
        self.d1, self.d2 = katz.discounts(of(self.c1)), katz.discounts(of(self.c2))
        self.unknown = 1 - sum(self.kept(c, self.d1) for c in self.c1.values()) / self.n
        seen = defaultdict(list)
        for h, w in self.c2:
            seen[h].append(w)
        self.weight = {
            h: (1 - sum(self.kept(self.c2[h, w], self.d2) / self.ch[h] for w in ws)) / (1 - sum(self.single(w) for w in ws))
            for h, ws in seen.items()
        }

    def kept(self, c, d):
        return d[c] * c if c <= katz.CUT else c - katz.ABOVE

    def single(self, w):
        return self.kept(self.c1[w], self.d1) / self.n if self.c1[w] else self.unknown

    def p(self, h, w):
        if self.c2[h, w]:
            return self.kept(self.c2[h, w], self.d2) / self.ch[h]
        return self.weight.get(h, 1.0) * self.single(w)


@pytest.mark.parametrize("small", [False, True])
def test_scores_match_brute_force(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
        monkeypatch.setattr(katz, "RANGE_TOKENS", 400)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["The", "É"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), "c") for i in range(200)]
    rows += [(500, None, "c"), (501, "", "c"), (None, "the null", "c"), (7, rows[7][1], "c")]
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    m = Brute([t for i, t, _ in rows if not held(i)])
    for h in [0, "w1", "the", "nowhere", *rng.sample(sorted(w for w in m.c1 if w), 30)]:
        total = sum(m.p(h, w) for w in m.c1) + m.p(h, "never seen")
        assert total == pytest.approx(1, abs=1e-9)
    want = []
    for i, t, _ in rows:
        w = tokens_of(t)
        base = sum(math.log10((m.c1[x] + 0.1) / (m.n + 0.1 * (len(m.c1) + 1))) for x in w)
        score = sum(math.log10(m.p(h, x)) for h, x in zip([0, *w[:-1]], w, strict=True))
        want.append((-1 if i is None else i, held(i), len(w), sum(m.c1[x] > 0 for x in w), m.n, base, score))
    have = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert katz.score(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in katz.score(df, training=F.lit(False)).collect()}
    assert got[1].score == 0 and got[1].n_known == 0 and got[1].train_tokens == 0
