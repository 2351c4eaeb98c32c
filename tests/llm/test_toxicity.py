import itertools
import random
import re
import zlib

import numpy as np
import pytest
from orrery.llm import toxicity as tx


def brute_kernel(s, t, p, decay):
    total = 0.0
    for i in itertools.combinations(range(len(s)), p):
        for j in itertools.combinations(range(len(t)), p):
            if [s[k] for k in i] == [t[k] for k in j]:
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_matches_all_subsequences():
    rng = random.Random(1)
    for p in (1, 2, 3, 4):
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))) for _ in range(12)]
        got = tx.kernel(tx._matrix(words), b"abcab", p, 0.6)
        assert got == pytest.approx([brute_kernel(w, b"abcab", p, 0.6) for w in words])


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "ru", "so"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 90))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["blarghead", "snivwit", "Snivwit,", "zubplod" + word()]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_disguises(spark):
    rows = corpus(1500, 2)
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(9000, None, "c"), (9001, "", "c"), (None, "x", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    assert {tx.BEGIN + w for w in (b"blarghead", b"snivwit", b"zubplod")} <= set(model.landmarks.strings)
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    assert len(got) == 1503 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= tx.THRESHOLD, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert got[9000] == got[9001] < 0.1
    for t in ("ka blarghead mi", "ka b l a r g h e a d mi", "lo snivw-it ka", "so BLARG.HEAD"):
        assert model.scores([t])[0] > 20 * got[9000], t
    measured = recall(model, [t for i, t, y in rows if y and zlib.crc32(str(i).encode()) % 3 == 1])
    assert measured["exact"] >= 0.95 and min(measured.values()) >= 0.8, measured


def recall(model, texts):
    """The share of toxic texts that are predicted, as they are and with each insult disguised."""
    rng, found = random.Random(9), {}
    shape = re.compile("blarghead|snivwit|zubplod", re.IGNORECASE)

    def put(sign):
        def change(m):
            at = 1 + rng.randrange(len(m[0]) - 1)
            return m[0][:at] + sign + m[0][at:]

        return change

    ways = {"exact": lambda m: m[0], "spelt": lambda m: " ".join(m[0]), "gap": put("--")} | {c: put(c) for c in "-.*_xe"}
    for name, change in ways.items():
        found[name] = float((model.scores([shape.sub(change, t) for t in texts]) >= tx.THRESHOLD).mean())
    return found


def test_map_of_landmarks_has_their_kernel():
    """What the Nyström map gives for single windows is their kernel; sums over words add up."""
    strings = [b"blarghead", b"snivwit", b"snivel", b"zubplod"]
    m = tx.Landmarks(strings)
    own = [brute_kernel(s, s, tx.ORDER, tx.DECAY) for s in strings]
    want = [[(brute_kernel(s, t, tx.ORDER, tx.DECAY) / (a * b) ** 0.5) ** tx.POWER for t, b in zip(strings, own, strict=True)] for s, a in zip(strings, own, strict=True)]
    assert np.linalg.pinv(m.root @ m.root) == pytest.approx(np.array(want) + 1e-3 * np.eye(4), abs=1e-9)
    at, values = m.of_words(strings[:2])
    assert values[np.argsort(at)][[0, 1], [0, 1]] == pytest.approx([1, 1])
    one, two, both = m.of_texts(["xblarghead", "snivwit", "xblarghead snivwit"])
    dims = len(strings)
    length = lambda v: np.linalg.norm(v[dims:])
    assert both[dims:] * 2**0.5 == pytest.approx(one[dims:] + two[dims:])
    for v, n in ((one, 1), (two, 1), (both, 2)):
        assert v[:dims] * (length(v) * n**0.5) ** 0.5 == pytest.approx(v[dims:] * n**0.5)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in tx.score(docs, model).collect()] == [0, 0]
    assert tx.score(docs.limit(0), model).count() == 0
    assert tx.Landmarks([b"abcd"]).of_texts([None, "", "x" * 500 + "abcd" + "y" * 500]).shape == (3, 2)


PLAIN = ["you are an idiot", "what a moron", "trash", "pathetic loser", "you worthless clown"]
DISGUISED = ["i.d.i.o.t", "mo*ron", "id-iot", "what an id-iot you are", "TRA_SH"]


@pytest.mark.parametrize("folder,caught,least", [("sf0.01", 0.7, 0.5), ("sf0.1", 0.88, tx.THRESHOLD)])
def test_given_tables(spark, folder, caught, least):
    """One-sentence insults, plain and disguised, are toxic, or with some 30 toxic texts to learn from likelier so than not; clean
    sentences and the empty text are not."""
    import os

    if not os.path.isdir(f"/root/testdata/{folder}"):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = tx.fit(docs, labels)
    clean = model.scores(["The weather is nice today", "", None, "the of and with"])
    assert max(clean) < 0.1
    assert min(model.scores(PLAIN)) >= least, model.scores(PLAIN)
    assert min(model.scores(DISGUISED)) >= least, model.scores(DISGUISED)
    rows = docs.join(labels, "doc_id").where(tx.is_held_out("doc_id")).select("text", "toxic").collect()
    found = model.scores([r["text"] for r in rows]) >= tx.THRESHOLD
    bad = np.array([r["toxic"] == 1 for r in rows])
    assert found[bad].mean() >= caught and found[~bad].mean() <= 0.005


def test_more_insults_never_lower_a_value():
    rng = random.Random(9)
    words = ["ka", "lo", "mi", "ten", "ru", "so"]
    toxic = [" ".join([rng.choice(words) for _ in range(20)] + [rng.choice(["blarghead", "snivwit"])]) for _ in range(60)]
    model = tx.Model(toxic, [" ".join(rng.choice(words) for _ in range(20)) for _ in range(200)], 60, 200)
    for t in ("", "ka lo", "blarghead mi", " ".join(words * 9)):
        for w in ("blarghead", "sniv-wit", "blarg"):
            # Of the same number of words, the one with the insult scores no less.
            assert model.scores([t + " " + w])[0] >= model.scores([t + " " + "zzz"])[0] - 1e-12


def test_machine_keeps_weights_from_falling_below_zero():
    rng = np.random.default_rng(0)
    x = np.c_[rng.random((300, 4)), rng.random((300, 2))]
    y = np.where(x[:, 0] - 2 * x[:, 1] + x[:, 4] > 0.3, 1.0, -1.0)
    w = tx.machine(x, y, np.ones(300), np.eye(4))
    assert (w[:4] >= 0).all() and w[0] > 0 and w[1] == 0


def test_ties_repeats_and_equal_texts(spark):
    """A repeated id with other texts counts each; equal texts have equal scores; unlabelled rows are scored."""
    rows = corpus(400, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, "snivwit"), (3, "snivwit"), (7000, "snivwit")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(14, 0)], "doc_id long, toxic int")
    scored = tx.score(docs, tx.fit(docs, labels)).collect()
    assert len(scored) == 403 and len({r.score for r in scored if r.text == "snivwit"}) == 1
