import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from orrery.llm import automata, collocations


def brute(docs, least, most=2000):
    f, size = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = defaultdict(int)
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * inside[lang, p] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:most]):
            rows.append((lang, rank + 1, p.decode(), -a, x, y, size[lang], -score))
    return sorted(rows)


def corpus():
    rng = random.Random(11)
    words = ["the", "of", "New", "york", "é", "z\x0e", "state", "b", "c", "d"]
    docs = []
    for i in range(160):
        some = [rng.choice(words) if rng.random() < 0.7 else rng.choice(["New York State", "of the", "b c d b"]) for _ in range(rng.randrange(60))]
        docs.append((rng.choice([" ", "  ", "\t"]).join(some).replace("d d", rng.choice(["d. d", "d\n d", "d,d"])), ["en", "de", None, "", "hot"][i % 5]))
    return [*docs, (None, "en"), ("", None), (" . ", "en"), ("hot pair " * 4000, "hot"), ("hot pair " * 4000, "hot"), ("word", "one"), ("a b", "und")]


@pytest.mark.parametrize("run,per_range,fan,piece", [(10**6, 10**6, 256, 1 << 20), (500, 300, 256, 1 << 20), (7, 200, 3, 64), (2, 900, 2, 5)])
def test_mined_is_that_of_all_phrases(spark, monkeypatch, run, per_range, fan, piece):
    for name, value in (("SHARD_TOKENS", run), ("RANGE_TOKENS", per_range), ("PIECE", piece), ("LEAST", 12)):
        monkeypatch.setattr(collocations, name, value)
    docs = corpus()
    if run < 10:
        docs = [(t if t is None else t[:700], lang) for t, lang in docs]
    df = spark.createDataFrame([(t, lang, 1, "p") for t, lang in docs], "text string, lang string, n int, phrase string").repartition(3)
    got = collocations.mined(df, fan=fan)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(docs, 12)
    assert len(want) > 50
    assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.mined(df).count() == 0
    assert collocations.mined(spark.createDataFrame([(None, None)], df.schema)).count() == 0


def sequences(rng, n):
    out = Counter()
    for _ in range(n):
        k = rng.randrange(1, 6)
        out[tuple(rng.choice([b"a", b"b", b"cc", "é".encode()]) for _ in range(k)) + (b"",) * (5 - k)] += rng.choice([1, 1, 1, 7, 10**12])
    return out


def built(counts):
    names = sorted({x for s in counts for x in s} | {b"", b"unused"})
    rows = sorted(counts)
    columns = [np.array([names.index(s[d]) for s in rows]) for d in range(5)]
    return automata.Automaton.of(names, columns, np.array([counts[s] for s in rows]))


def spelled(a):
    columns, weights = a.sequences()
    return {tuple(a.names[k] for k in s): int(w) for *s, w in zip(*[c.tolist() for c in columns], weights.tolist(), strict=True)}


def test_automata_keep_their_sequences_and_share_states():
    rng = random.Random(2)
    for n in (1, 5, 400):
        counts = sequences(rng, n)
        a = built(counts)
        assert spelled(a) == counts and spelled(automata.Automaton.load(a.dump())) == counts
        asked = [*counts, (b"a", b"nowhere"), (b"zz",)]
        assert a.compose(asked).tolist() == [counts.get((*s, *[b""] * (5 - len(s))), 0) for s in asked]
    twins = built({(x, b"b", b"cc", b"", b""): 1 for x in (b"a", b"b", b"cc")})
    assert [len(x) for x in twins.arcs] == [1, 1, 1, 1, 1]


def test_union_adds_weights():
    rng = random.Random(4)
    some = [sequences(rng, 60) for _ in range(5)]
    names, columns, weights = automata.union([built(c) for c in some])
    got = {tuple(names[k] for k in s): int(w) for *s, w in zip(*[c.tolist() for c in columns], weights.tolist(), strict=True)}
    assert got == sum(some, Counter())
    rows = sorted(got)
    for cut in [*rows[:: len(rows) // 7], (b"",) * 5, (b"zz",) * 5, (b"a", b"aa", b"", b"", b"")]:
        assert automata.place(names, columns, cut) == sum(s < cut for s in rows)
