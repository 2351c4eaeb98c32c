import random
import re

import pytest
import xxhash
from orrery.llm import simhash
from orrery.llm.components import components


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """{id: least id of its component} from (id, fp), by all pairs."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in fps:
        for j, y in fps:
            if i < j and (x ^ y).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in fps}


def test_fingerprints():
    for t in (None, "", " \n", "one", "One two", "a b c", "A b\tC d é É \x0b z" * 30, "w " * 500):
        assert simhash.simhash(t) == brute_fp(t), t


def test_masks_cover_every_pair():
    rng = random.Random(1)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            diff = sum(1 << p for p in rng.sample(range(64), radius))
            assert any(not diff & m for m in masks)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_near_duplicates_match_all_pairs(spark, bucket, monkeypatch):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, 0, 0]
    for _ in range(250):
        x = rng.choice(fps)
        for p in rng.sample(range(64), rng.choice((0, 1, 2, 3))):
            x ^= 1 << p
        fps.append(x)
    rows = [(i * 3 + 1, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    monkeypatch.setattr(simhash.covering_links, "__defaults__", (2, bucket))
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == brute_components([(i, x) for (i, _), x in zip(rows, fps, strict=True)], 2)


def test_edge_cases(spark):
    df = spark.createDataFrame([(5, None, "c"), (3, "", "c"), (None, "x y", "c")], "doc_id long, text string, fingerprint string")
    marked = simhash.fingerprints(df)
    assert marked.columns == ["doc_id", "text", "fingerprint"]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(marked).collect()}
    assert got == {5: 3, 3: 3, None: None}
    assert simhash.near_duplicates(marked.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    ids = list(range(400))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(7, 7), (None, 3)], "a long, b long")
    got = {(r.node, r.root) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(400)}


def near_pairs(rng, n, flips):
    """n random wide fingerprints, each followed by one that differs in ``flips`` bits."""
    out = []
    for _ in range(n):
        x = rng.getrandbits(256)
        y = x
        for p in rng.sample(range(256), flips):
            y ^= 1 << p
        out += [x, y]
    return out


def hot_pairs(rng, n):
    """n pairs that differ in 45 bits, two of them in the first part, whose bits are the same in all pairs but for those."""
    parts, out = simhash.PARTS, []
    first = sum(1 << p for p in range(0, 256, parts))
    base = rng.getrandbits(256) & first
    for _ in range(n):
        x = base | rng.getrandbits(256) & ~first
        y = x
        for part in range(parts):
            for p in rng.sample(range(part, 256, parts), 2 if not part else 5 if part < 8 else 4):
                y ^= 1 << p
        out += [x, y]
    return out


def wide_frame(spark, fps):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *[signed(x >> 64 * k & (1 << 64) - 1) for k in range(4)]) for i, x in enumerate(fps)]
    return spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")


@pytest.mark.parametrize("bucket", [4096, 64])
def test_wide_links_have_the_same_recall_at_every_size(spark, bucket):
    """Pairs as far apart as texts of a similarity of 0.8 are, with buckets under and far over the bound."""
    fps = near_pairs(random.Random(4), 400, 42) + hot_pairs(random.Random(5), 200)
    masks = [sum(m << 64 * k for k, m in enumerate(per)) for per in simhash.wide_masks()]
    met = {i for i in range(0, 1200, 2) if any(not (fps[i] ^ fps[i + 1]) & m for m in masks)}
    got = {tuple(sorted((r.a, r.b))) for r in simhash.similar_links(wide_frame(spark, fps), 0.8, bucket).collect()}
    assert got == {(i, i + 1) for i in met} and len(met) >= 0.98 * 600


@pytest.mark.parametrize("bucket", [8, 40])
def test_large_links_are_those_of_all_pairs(spark, bucket):
    """Keys with a dense group, chains out of it, and rows that are like nothing."""
    rng = random.Random(8)
    rows, want = [], set()
    for key in range(3):
        fps = [rng.getrandbits(256)]
        for k in range(90):
            x = fps[0] if k < 40 or rng.random() < 0.3 else rng.choice(fps)
            for p in rng.sample(range(256), rng.choice((3, 20, 30, 50, 60, 120))):
                x ^= 1 << p
            fps.append(x)
        rng.shuffle(fps)
        fps = list(dict.fromkeys(fps))
        rows += [(key, 1000 * key + i, x) for i, x in enumerate(fps)]
        want |= set(brute_components([(1000 * key + i, x) for i, x in enumerate(fps)], 56).items())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [f"f{k}" for k in range(4)]
    flat = [(key, i, *[signed(x >> 64 * k & (1 << 64) - 1) for k in range(4)]) for key, i, x in rows]
    df = spark.createDataFrame(flat, "key long, node long, f0 long, f1 long, f2 long, f3 long")
    found = simhash.links(df.drop("key"), 56, words, [[(0, 0, 0, 0)]], None, bucket)
    together = {(r.node, r.root) for r in components(found).collect()}
    every = brute_components([(i, x) for _, i, x in rows], 56)
    linked = {v for k, v in every.items() if k != v}
    assert together == {(k, v) for k, v in every.items() if v in linked}
    from pyspark.sql import functions as F

    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p.{w}"))) for w in words), F.lit(0))
    per_key = simhash.large_links(df, words, apart, 56, bucket, lambda x: simhash._compared(x, 56, words))
    got = {r.node: r.root for r in components(per_key).collect()}
    assert {(i, got.get(i, i)) for _, i, _ in rows} == want


def test_pairs_of_blocks_bring_any_two_rows_together(spark):
    from pyspark.sql import functions as F

    for blocks in (1, 2, 5):
        groups = {}
        for r in simhash.in_pairs(spark.range(40), F.col("id"), F.lit(blocks)).collect():
            groups.setdefault((r.one, r.other), set()).add(r.id)
        assert all(any({a, b} <= g for g in groups.values()) for a in range(40) for b in range(40))
        assert len(groups) == max(1, blocks * (blocks - 1) // 2)


def brute_jaccard(texts, k=5):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or {" ".join(w)})
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def test_classes_are_those_of_the_exact_similarity(spark, monkeypatch):
    """Pairs on both sides of 0.8, a chain, repeated passages and odd texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for changed in [1, 2, 3, 4, 5, 6, 7, 8] * 6:
        words = [word() for _ in range(204)]
        texts.append(" ".join(words))
        for p in rng.sample(range(10, 195), changed):
            words[p] = word()
        texts.append(" ".join(words))
    words = [word() for _ in range(204)]
    for k in range(12):
        words[k * 16 : k * 16 + 6] = [word() for _ in range(6)]
        texts.append(" ".join(words))
    # Votes of repeated shingles make fingerprints equal, sets share little.
    passage = " ".join(word() for _ in range(5))
    texts += [" ".join([passage] * 60 + [word() for _ in range(40)]) for _ in range(3)]
    texts += ["", None, " \n", "two words", "Two  words"]
    like = brute_jaccard([(t or "").lower() for t in texts])
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if like(i, j) >= 0.8 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if v == old else v for k, v in want.items()}
    assert 20 < len(set(want.values())) < len(texts) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for defaults in ((4096, 4_000_000), (4, 900)):
        monkeypatch.setattr(simhash.confirmed_links, "__defaults__", defaults)
        got = {r.doc_id: r.component_id for r in simhash.similar_classes(df).collect()}
        assert got == want
