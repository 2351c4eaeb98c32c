import math
import random
from collections import Counter, defaultdict

import pytest
from orrery.llm import katz, katz_tables
from pyspark.sql import functions as F
from test_katz import tokens_of


class Brute:
    """A model of any order by recursion over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts, self.after = order, [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for t in texts:
            w = [0] * (order - 1) + tokens_of(t)
            for i in range(order - 1, len(w)):
                for n in range(order):
                    self.counts[n][tuple(w[i - n : i]), w[i]] += 1
        self.d, self.weight = [], [{} for _ in range(order)]
        for n, c in enumerate(self.counts):
            for (h, _), k in c.items():
                self.after[n][h] += k
            self.d.append(katz.discounts([0, *[sum(v == r for v in c.values()) for r in range(1, katz.CUT + 2)]]))
        self.unknown = 1 - sum(self.seen(0, (), w) for _, w in self.counts[0])
        for n in range(1, order):
            followers = defaultdict(list)
            for h, w in self.counts[n]:
                followers[h].append(w)
            for h, ws in followers.items():
                self.weight[n][h] = (1 - sum(self.seen(n, h, w) for w in ws)) / (1 - sum(self.p(n - 1, h[1:], w) for w in ws))

    def seen(self, n, h, w):
        c = self.counts[n][h, w]
        return (self.d[n][c] * c if c <= katz.CUT else c - katz.ABOVE) / self.after[n][h]

    def p(self, n, h, w):
        if self.counts[n][h, w]:
            return self.seen(n, h, w)
        return self.unknown if n == 0 else self.weight[n].get(h, 1.0) * self.p(n - 1, h[1:], w)

    def score(self, text):
        w = [0] * (self.order - 1) + tokens_of(text)
        return sum(math.log10(self.p(self.order - 1, tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


def texts_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(120)] + ["The", "É", "the"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_tables_score_other_texts(spark, tmp_path, order):
    train, other = texts_of(1, 120), [*texts_of(2, 25), None, "", "never seen words", "the THE the"]
    rows = [(i, t, "c") for i, t in enumerate(train)] + [(None, "the null", "c"), (3, train[3], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w string").repartition(3)
    path = f"file://{tmp_path}/model"
    katz_tables.train(docs, path, order, training=F.lit(True))
    model, brute = katz_tables.load(spark, path), Brute([t for _, t, _ in rows], order)
    assert (model.order, model.tokens, model.types) == (order, sum(brute.counts[0].values()), len(brute.counts[0]))
    vocabulary = [w for _, w in brute.counts[0]]
    for n in range(order):
        for h in list(brute.after[n])[:40]:
            total = sum(brute.p(n, h, w) for w in vocabulary) + brute.p(n, h, "never seen")
            assert total == pytest.approx(1, abs=1e-9), (n, h)
    asked = spark.createDataFrame([(i, t, "c") for i, t in enumerate(other)] + [(None, "w1 w1", "c")], "doc_id long, text string, h1 string")
    got = {r.doc_id: (r.n_tokens, r.score) for r in katz_tables.score(asked, model).collect()}
    assert len(got) == len(other) + 1
    for i, t in [*enumerate(other), (None, "w1 w1")]:
        assert got[i][0] == len(tokens_of(t)) and got[i][1] == pytest.approx(brute.score(t), rel=1e-9)
    folders = {p.name for p in (tmp_path / "model" / "grams").iterdir() if p.is_dir()}
    assert folders == {f"n={n}" for n in range(1, order + 1)}
    with pytest.raises(Exception, match="exists"):
        katz_tables.train(docs, path, order, training=F.lit(True))


def test_probabilities_of_every_token_sum_to_one(spark, tmp_path):
    """The stored probabilities after a history, for each token of the vocabulary and an unknown one."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(3, 60))], "doc_id long, text string")
    path = f"file://{tmp_path}/model"
    katz_tables.train(docs, path, 3, training=F.lit(True))
    model = katz_tables.load(spark, path)
    histories = katz_tables.positions(docs, "text", 3, []).select("h1", "h2", "h3").distinct().orderBy("h3").limit(30)
    words = model.grams.where("n = 1").select("w").unionByName(spark.createDataFrame([(17,)], "w long"))
    sums = katz_tables.probabilities(words.crossJoin(histories), model).groupBy("h3").agg(F.sum("p").alias("p")).collect()
    assert len(sums) == 30 and all(r.p == pytest.approx(1, abs=1e-9) for r in sums)


def test_pairs_score_as_the_packed_model_does(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(4, 150))], "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/model"
    katz_tables.train(docs, path, 2)
    stored = {r.doc_id: r.score for r in katz_tables.score(docs, katz_tables.load(spark, path)).collect()}
    packed = {r.doc_id: r.score for r in katz.score(docs).collect()}
    assert stored == pytest.approx(packed, rel=1e-9)


def test_nothing_to_learn(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for name, rows in (("none", docs), ("empty", docs.limit(0))):
        katz_tables.train(rows, f"file://{tmp_path}/{name}", 3, training=F.lit(False))
        model = katz_tables.load(spark, f"file://{tmp_path}/{name}")
        assert {r.doc_id: r.score for r in katz_tables.score(docs, model).collect()} == {1: 0.0, 2: 0.0}
        assert katz_tables.score(docs.limit(0), model).count() == 0
