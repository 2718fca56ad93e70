"""The driver's entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.oracle_sql()) - set(e.queries())))"


@pytest.mark.parametrize("gone", [("hitledger/llm", "tests/llm", "corpus_pipeline.py"), ("hitledger/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_entry_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache")
                                                               or str((Path(folder) / n).relative_to(ROOT)) in gone])
    shown = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert shown.returncode == 0, shown.stderr
    n_queries, n_twins, unknown = shown.stdout.split(maxsplit=2)
    assert int(n_queries) == int(n_twins) > 70 and unknown.strip() == "[]"
