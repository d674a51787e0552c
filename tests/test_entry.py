"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, sum(k.startswith('op') for k in q))"


@pytest.mark.parametrize(("leave_out", "pipeline", "ops"), [((), True, 13), (("llm", "corpus_pipeline.py"), False, 0), (("llm",), False, 0), (("corpus_pipeline.py",), False, 13)])
def test_queries_without(tmp_path, leave_out, pipeline, ops):
    if not ops or not os.path.isdir(f"{ROOT}/metascrub/llm"):
        pipeline, ops = False, 0
    skip = shutil.ignore_patterns(*leave_out, "__pycache__", ".git", "*.json")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 80 and said[1:] == [str(pipeline), str(ops)]
