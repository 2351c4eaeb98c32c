import base64
import hashlib
import random

import numpy as np
import pytest
from orrery.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RULES = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="module")
def library():
    """An encoder that shares nothing with the operator but the rank file."""
    with open(RULES[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=RULES[1], mergeable_ranks=ranks, special_tokens={})


ALPHABETS = ["ab c", "aB1 \n", "é ñ'ß12", " \t\n\r 　x", "日本語 テ́a", "🙂‍👩a 1", "'s 're!? <|endoftext|>", "0123456789 ,."]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("limit", [1, 3, 17, byte_bpe.PIECE_CHARS])
def test_ids_are_the_library_s_wherever_a_text_is_cut(library, limit):
    for t in [*odd_texts(3000), *ALPHABETS, "<|endoftext|>", " " * 50, "\n" * 9 + "x"]:
        assert byte_bpe.encode_text(library, t, limit).tolist() == library.encode_ordinary(t), repr(t)
        assert "".join(byte_bpe.safe_pieces(t, limit)) == t


def test_table_with_odd_rows(spark, library):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdeé1'") for _ in range(rng.randrange(1, 12))) for _ in range(60_000))
    texts = [None, "", " ", long, "a" * 3000, "x" * 70_000, *odd_texts(200, 2), "same", "same"]
    rows = [(k, t, "theirs", "mine", k) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, TOKEN_IDS string, decoded string, n_tokens int"
    df = spark.createDataFrame([*rows, (None, "no id", None, None, None)], schema)
    ids = byte_bpe.encode(df, *RULES)
    assert ids.columns == ["doc_id", "text", "decoded", "token_ids", "n_tokens"]
    got = byte_bpe.decode(ids, *RULES)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]
    seen = got.collect()
    assert len(seen) == len(rows) + 1
    for r in seen:
        want = library.encode_ordinary(r.text or "")
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_text_and_bytes_that_stay_in_the_worker(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id long, text string")
    got = byte_bpe.decode(byte_bpe.encode(df, *RULES, keep_text=False), *RULES, digest_only=True)
    assert got.columns == ["doc_id", "token_ids", "n_tokens", "decoded"]
    assert {r.doc_id: r.decoded for r in got.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((1, "héllo wörld"), (2, ""))}


def test_bytes_of_parts_of_a_character(spark, library):
    """Ids that cut a character in two decode to its raw bytes."""
    ids = library.encode_ordinary("👩‍🚀 naïve 𝔘")
    rows = [(k, np.array([x], "<u4").tobytes()) for k, x in enumerate(ids)]
    got = byte_bpe.decode(spark.createDataFrame(rows, "k int, token_ids binary"), *RULES).orderBy("k").collect()
    assert b"".join(bytes(r.decoded) for r in got) == "👩‍🚀 naïve 𝔘".encode()


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(df, *RULES), *RULES).count() == 0
    nulls = spark.createDataFrame([(None,), (b"",)], "token_ids binary")
    assert [bytes(r.decoded) for r in byte_bpe.decode(nulls, *RULES).collect()] == [b"", b""]


def test_an_id_without_a_rank_is_an_error(spark):
    bad = spark.createDataFrame([(np.array([60_000], "<u4").tobytes(),)], "token_ids binary")
    with pytest.raises(Exception, match="60000"):
        byte_bpe.decode(bad, *RULES).collect()
