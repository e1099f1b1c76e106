"""The entry module without the operators for training data."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_imports_without_the_subpackage(tmp_path, pipeline_stays):
    gone = [".git", "llm", "__pycache__", *["corpus_pipeline.py"] * (not pipeline_stays)]
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; assert 'hybrid_rerank' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_other_tests_do_without_the_subpackage(tmp_path):
    """The rest of the suite is collected in a copy without both folders, and some of it that needs no session is run."""
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    env = os.environ | {"PYTHONPATH": str(copy)}
    for more in (["--collect-only", "tests"], ["tests/test_families.py::test_longest_common_subsequence", "tests/test_streams.py::test_what_a_brace_comes_to"]):
        done = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *more], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stdout + done.stderr
