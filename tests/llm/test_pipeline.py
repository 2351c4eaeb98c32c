import random
from collections import Counter

import pytest
from orrery.llm import mixing, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture()
def folder(spark, tmp_path):
    """Clean texts, exact and near copies, junk, a boilerplate line, nulls and odd rows."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows, kinds = [], {}

    def add(text, kind, source="s1"):
        kinds[len(rows)] = kind
        rows.append((len(rows), text, "en", source, len(text or ""), "extra"))

    for k in range(60):
        add("\n".join(["Site menu of all pages", " ".join(word() for _ in range(120)), " ".join(word() for _ in range(40))]), "clean", ["s1", "s2", "s3"][k % 3])
    for k in range(10):
        add(rows[k][1], "copy", rows[k][3])
        words = rows[k + 20][1].split(" ")
        words[50] = "changed"
        add(" ".join(words), "near", rows[k + 20][3])
    for t in ("too short", "", None, "same five words here again " * 30):
        add(t, "junk")
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}", rows, kinds


def test_stages(spark, folder):
    path, rows, kinds = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    from orrery.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, path), name)
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id for r in seen["quality_rules"]}
    assert kept == {k for k, v in kinds.items() if v != "junk"}
    lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert all("Site menu" not in t and t == rows[k][1].split("\n", 1)[1] for k, t in lines.items() if kinds[k] != "near")
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    single = sorted(r.doc_id for r in seen["simhash_near_dedup"])
    assert single == list(range(60))
    size = Counter()
    for r in seen["simhash_near_dedup"]:
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in seen["mixing"]:
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 3 * 170
    assert max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 2
    assert len(seen["byte_bpe"]) == len(seen["mixing"]) and all(r.round_trip for r in seen["byte_bpe"])
    assert before.count() == len(seen["mixing"])


def test_empty(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_repeated_rows_of_a_mix(spark):
    rows = [(1, "a b c", "x", "k")] * 3 + [(None, "d e", "x", "k"), (2, None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mixed(df).collect()
    assert {r.doc_id for r in got} <= {1, 2, None} and len(got) <= 2 * len(rows)
    assert quality.with_metrics(df).count() == len(rows)
