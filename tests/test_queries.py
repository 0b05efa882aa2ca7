import json
import os
import shutil
import subprocess
import sys

import pytest

from marlstone.plans import ORACLES, QUERIES
from tests.conftest import ROOT
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    assert name in ORACLES
    check(spark, sf, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_without_training_data_operators(tmp_path):
    """With that subpackage and its tests deleted, all else stays as it is."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"

    def ask():
        env = {**os.environ, "PYTHONPATH": str(copy)}
        return json.loads(subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout)

    for folder in ("marlstone/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    assert ask() == [sorted(QUERIES), sorted(ORACLES)]  # what it is made of is gone
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert ask() == [sorted(QUERIES), sorted(ORACLES)]
    (copy / "marlstone" / "llm").mkdir()
    (copy / "marlstone" / "llm" / "__init__.py").write_text("raise ImportError('half there')\n")
    assert ask() == [sorted(QUERIES), sorted(ORACLES)]
    out = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True)
    assert out.returncode == 0 and "test_queries.py" in out.stdout
