import heapq
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from orrery.llm import huffman as hf

P = pytest.importorskip("public_tokenizers")


def huffman_cost(weights):
    heap, cost = list(weights), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


def test_code_lengths():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 200):
        w = np.sort(rng.integers(1, 1000, n))
        lengths = hf.code_lengths(w, 18)
        assert (2.0 ** -lengths).sum() == pytest.approx(1) and (lengths * w).sum() == huffman_cost(w.tolist())
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    best = min(
        sum(a * b for a, b in zip(ls, fib, strict=True))
        for ls in itertools.product(range(1, 5), repeat=8) if sum(2.0**-x for x in ls) <= 1
    )
    short = hf.code_lengths(fib, 4)
    assert short.max() <= 4 and (short * fib).sum() == best


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 0, 255, 256, 257, 5000, 3])
    ids = np.minimum(rng.zipf(1.3, int(sizes.sum())), 40000).astype(np.uint32)
    code = hf.Code.fitted(dict(zip(*[x.tolist() for x in np.unique(ids, return_counts=True)], strict=True)))
    data, used, checks = code.encode(ids, sizes)
    assert (code.decode(data, used, sizes, checks) == ids).all()
    one = hf.Code.fitted({7: 5})
    data, used, checks = one.encode(np.full(5, 7, np.uint32), np.array([5]))
    assert (one.decode(data, used, np.array([5]), checks) == 7).all()


def test_words_are_encoded_as_whole_texts_are():
    path = P.path("word_bpe_49k.json")
    rng = random.Random(3)
    parts = ["Don't", "İx", "é́", "a\x1cb", "　", "<|endoftext|>x", "12ab", "ﬁ", "...", "ΑΣ", "\x85", "the", "it's", "Word,", "ÉTÉ!", "a<b", "x²", "don", "'t", "İ!"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n\t", "\xa0"]) for _ in range(30)) for _ in range(50)]
    got = hf.WordIds(path).texts(pa.array([*texts, None, ""]), 2).to_pylist()
    want = [hf._tokenizer(path).encode(t, add_special_tokens=False).ids + [2] for t in texts] + [[2], [2]]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_any_words_and_little_memory(limit):
    """Random words of letters, signs and marks; what is remembered may be forgotten at any time."""
    path, rng = P.path("word_bpe_49k.json"), random.Random(5)
    latin = "".join(map(chr, range(0xA1, 0x180)))
    alphabets = ["abcXYZ", "aé" + latin, latin, "ab" + hf.SIGNS, "ñ" + hf.SIGNS, "a'sTé", "e\u0301\u0327aÅ", "日本aé", "ıİKÅß", "x\u00ad\u200by"]
    words = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 9))) for a in alphabets for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(150)]
    texts += [" a b ", "\t\n", "", " ", "x" * 3000]
    known = hf.WordIds(path, limit)
    got = [x for s in range(0, len(texts), 40) for x in known.texts(pa.array(texts)[s : s + 40], 2).to_pylist()]
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, "<u4").tolist() == [*hf._tokenizer(path).encode(t, add_special_tokens=False).ids, 2], t


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    """Whatever its case and the signs after it, and while it keeps occurring, whatever comes between."""
    path, encoded = P.path("word_bpe_49k.json"), []
    known = hf.WordIds(path, 60)
    letters = known._letters
    monkeypatch.setattr(known, "_letters", lambda runs: encoded.extend(runs) or letters(runs))
    for k in range(12):
        others = " ".join(chr(97 + k) + chr(97 + i) for i in range(20))
        text = f"Word word, WORD! wörd WÖRD. wörd?! {others}"
        got = known.texts(pa.array([text]), 2)[0].as_py()
        assert np.frombuffer(got, "<u4").tolist() == [*hf._tokenizer(path).encode(text, add_special_tokens=False).ids, 2]
        assert len(known.known) <= 60
    assert encoded.count("word") == encoded.count("wörd") == 1 and len(encoded) == 2 + 12 * 20


def test_files_and_blocks_are_in_order_of_the_ids(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(hf, "BLOCK_IDS", 40)
    rows = [(k * 7919 % 1009, np.arange(k % 9, dtype="<u4").tobytes()) for k in range(1009)] + [(None, b""), ((1 << 63) - 1, b"")]
    df = spark.createDataFrame(rows, "id long, ids binary").repartition(3)
    hf.write(df, f"file://{tmp_path}/t")
    book = spark.read.parquet(f"file://{tmp_path}/t/codebook").first()
    code, seen = hf.Code(np.frombuffer(book["lengths"], np.uint8).astype(np.int64)), []
    files = sorted(glob.glob(f"{tmp_path}/t/blocks/*.parquet"))
    assert len(files) > 1
    for f in files:
        for raw in pq.read_table(f).column("payload").to_pylist():
            ids, present, _, _ = hf.unpack_block(raw, code)
            seen += [int(i) if p else None for i, p in zip(ids, present, strict=True)]
    assert seen == [None, *range(1009), (1 << 63) - 1]


def test_write_and_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hf, "BLOCK_IDS", 300)
    monkeypatch.setattr(hf, "SHARDS", 2)
    rng = random.Random(4)
    rows = [(i * 3 % 211, " ".join(rng.choice(["alpha", "Beta", "gam ma", "1", "ü"]) for _ in range(rng.randrange(0, 40))), "c") for i in range(211)]
    rows += [(1000, None, "c"), (None, "null id", "c"), (6, rows[2][1], "c"), (1001, "long " * 3000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    path = P.path("word_bpe_49k.json")
    hf.write(hf.token_ids(df, path, 2), f"file://{tmp_path}/t")
    got = sorted(hf.read(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    start = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda x: -1 if x[0] is None else x[0]), strict=True):
        want = hf._tokenizer(path).encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.id, r.start, r.n_tokens) == (i, start, len(want))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    hf.write(hf.token_ids(df.limit(0), path, 2), f"file://{tmp_path}/e")
    assert hf.read(spark, f"file://{tmp_path}/e").count() == 0
