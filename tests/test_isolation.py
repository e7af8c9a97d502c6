"""The rest of the library without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(folder, *args):
    return subprocess.run([sys.executable, *args], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True, timeout=300)


def test_the_rest_stands_alone(tmp_path):
    """With the subpackage, its tests and the pipeline gone, the entry imports, its queries are listed, and all other tests are collected."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "corpus_pipeline.py", "*.json", "*.txt"))
    listed = run(copy, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())")
    assert listed.returncode == 0, listed.stderr
    names = listed.stdout.split()
    assert len(names) > 400 and not [n for n in names if n.startswith("op") or n == "pipeline"]
    collected = run(copy, "-m", "pytest", "--collect-only", "-q", "tests")
    assert collected.returncode == 0, collected.stdout[-2000:]


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "tessera")):
        if "llm" in folder.split(os.sep):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "tessera.llm" not in (text := f.read()) and "from .llm" not in text and "from ..llm" not in text, name
