"""The entry points on copies of the repository that lack the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q); print(sum(x.startswith('op') or x == 'pipeline' for x in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_library_without_text_operators(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    got = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split()[-1] == "0"
