"""The entry with all there is, and in copies without the training-data subpackage or the pipeline."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    return json.loads(out.stdout.splitlines()[-1])


@pytest.mark.parametrize("gone", [["tidemill/llm", "tests/llm"], ["tidemill/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_without_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[Path(g).name for g in gone]))
    queries, sql = names(copy)
    assert "q01_best_stream" in queries and set(sql) <= set(queries)
    assert "pipeline" not in queries
    assert any(q.startswith("op") for q in queries) == ("tidemill/llm" not in gone and (ROOT / "tidemill/llm").exists())
