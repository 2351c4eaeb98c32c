import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    import __spark_entry__ as e

    if not os.path.isdir(SMALL):
        pytest.skip("no tables here")
    df = e.entry(spark)
    assert df.columns == ["l_suppkey", "label", "metric", "value", "value_winsorized"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_subpackage(tmp_path):
    """The other queries are there if the subpackage and the pipeline are deleted."""
    import shutil

    shutil.copytree(f"{REPO}/orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'margin_panel_winsorized' in q and 'pipeline' not in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert int(out.stdout.strip()) > 40
