"""The entry point without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without_the_subpackage(tmp_path, left_out):
    ignored = shutil.ignore_patterns(".git", "__pycache__", "tests", "*.json", "*.md", *left_out)
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "line_rule_scan" in names
    assert "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ("llm" not in left_out and (ROOT / "wardspark" / "llm").is_dir())
