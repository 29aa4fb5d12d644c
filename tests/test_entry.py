"""The entry module without the optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_parts(tmp_path):
    for both in (True, False):
        at = tmp_path / str(both)
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *(["corpus_pipeline.py"] if both else [])))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
