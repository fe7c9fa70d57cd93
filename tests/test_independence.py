"""The rest of the library without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(sorted(k for k in q if k == 'pipeline' or k.startswith('op')))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_without_the_llm_folders(tmp_path, pipeline):
    for name in ("loomwright", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[]"
