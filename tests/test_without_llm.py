"""The library, its registry and the entry point import without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_point_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    for name in ("pertinax", "__spark_entry__.py", "corpus_pipeline.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=skip)
        elif os.path.exists(src):
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    for pipeline in (True, False):
        if not pipeline and os.path.exists(tmp_path / "corpus_pipeline.py"):
            os.remove(tmp_path / "corpus_pipeline.py")
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr[-500:]
        n, has, whole = out.stdout.split()
        assert int(n) > 100 and has == "False" and whole == "True"
