"""The core works without the training-data subpackage and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, len(e.oracle_sql()))"


def said(folder, first=""):
    out = subprocess.run([sys.executable, "-B", "-c", first + SAYS], cwd=folder, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def copy(tmp_path, *without):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if "corpus_pipeline.py" not in without and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    shutil.copytree(ROOT / "opsloom", tmp_path / "opsloom", ignore=shutil.ignore_patterns("__pycache__", *without))
    return tmp_path


def test_without_both(tmp_path):
    n, ops, pipeline, sql = said(copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert int(n) > 100 and int(sql) > 100 and (ops, pipeline) == ("0", "False")


def test_without_the_subpackage_alone(tmp_path):
    n, ops, pipeline, _ = said(copy(tmp_path, "llm"))
    assert int(n) > 100 and (ops, pipeline) == ("0", "False")


def test_without_a_library_of_the_operators(tmp_path):
    n, *_ = said(copy(tmp_path), "import sys; sys.modules['zstandard'] = None; ")
    assert int(n) > 100
