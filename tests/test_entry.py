"""The driver's entry: it imports without a session, and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k.startswith('op') and k[2].isdigit() for k in e.queries()))"


def shown(folder: str) -> list[int]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def test_imports_without_a_session():
    every, sql, _ = shown(ROOT)
    assert every >= sql > 90


def test_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    every, sql, numbered = shown(str(tmp_path / "repo"))
    assert every >= sql > 90 and numbered == 0
