import os
import threading

import numpy as np
import pytest
from orrery.operators import corpus
from orrery.sources import versions


def folders(path):
    return sorted(x for x in os.listdir(path) if not x.startswith((".", "_")))


def test_readers_in_a_loop_never_fail(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "k int, v int"
    versions.replace(spark.createDataFrame([(k, 0) for k in range(20)], schema), path)
    seen, failed, stop = set(), [], threading.Event()

    def look():
        while not stop.is_set():
            try:
                rows = versions.read(spark, path, schema).collect()
                assert len(rows) == 20 and len({r["v"] for r in rows}) == 1
                seen.add(rows[0]["v"])
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for v in range(1, 6):
        versions.replace(spark.createDataFrame([(k, v) for k in range(20)], schema), path)
    stop.set()
    reader.join()
    assert not failed and seen
    assert versions.read(spark, path, schema).first()["v"] == 5
    assert len(folders(tmp_path / "t")) == versions.KEPT == len(versions.commits(spark, path))


@pytest.mark.parametrize("step", ["write", "check", "commit"])
def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, step):
    path, schema = f"file://{tmp_path}/t", "k int"
    versions.replace(spark.createDataFrame([(1,)], schema), path)
    new = spark.createDataFrame([(2,)], schema)

    def crash(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        if step == "write":
            monkeypatch.setattr(versions, "_files", crash)
            versions.replace(new, path)
        elif step == "check":
            versions.replace(new, path, check=crash)
        else:
            monkeypatch.setattr(versions, "commits", crash)
            versions.replace(new, path)
    monkeypatch.undo()
    assert [r["k"] for r in versions.read(spark, path, schema).collect()] == [1]
    versions.replace(spark.createDataFrame([(3,)], schema), path)
    assert [r["k"] for r in versions.read(spark, path, schema).collect()] == [3]


def test_a_failed_write_and_no_table(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "k int"
    assert versions.current(spark, path) is None and versions.read(spark, path, schema).count() == 0
    bad = spark.createDataFrame([(1,)], schema).selectExpr("CAST(raise_error('lost') AS INT) AS k")
    with pytest.raises(Exception, match="lost"):
        versions.replace(bad, path)
    assert versions.current(spark, path) is None and folders(tmp_path / "t") == []


def test_corpus_is_written_and_verified(spark, tmp_path, monkeypatch):
    def vectors(texts):
        return np.array([[len(t), t.count("a"), 1.0] for t in texts])

    monkeypatch.setattr(corpus, "BATCH", 3)
    path = f"file://{tmp_path}/c"
    rows = [(i if i % 5 else None, "a" * (i % 7) + "b", "E1") for i in range(40)] + [(50, None, "E0"), (3, "aaab", "E1")]
    df = spark.createDataFrame(rows, "id int, text string, embedding string").repartition(4)
    got = corpus.build(df, vectors, 3, path, ["id", "text"])
    assert got.columns == ["id", "text", "embedding"]
    want = sorted([(i, t, [float(len(t or "")), float((t or "").count("a")), 1.0]) for i, t, _ in rows], key=repr)
    assert sorted([(r["id"], r["text"], r["embedding"]) for r in got.collect()], key=repr) == want
    # Vectors of another width, values that aren't finite, and a table that reads back otherwise leave it as it is.
    for embed in (lambda ts: np.zeros((len(ts), 2)), lambda ts: np.full((len(ts), 3), np.nan), lambda ts: np.zeros((1, 3))):
        with pytest.raises(Exception, match="embedder"):
            corpus.build(df, embed, 3, path, ["id", "text"])
    real = corpus.summary
    monkeypatch.setattr(corpus, "summary", lambda *a: real(*a) | {"hash": 1})
    with pytest.raises(corpus.Unverified):
        corpus.build(df, lambda ts: np.ones((len(ts), 3)), 3, path, ["id", "text"])
    monkeypatch.undo()
    back = versions.read(spark, path, got.schema)
    assert sorted([(r["id"], r["text"], r["embedding"]) for r in back.collect()], key=repr) == want
    assert corpus.build(df.limit(0), vectors, 3, path, ["id"]).count() == 0
