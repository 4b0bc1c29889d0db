"""The engine stands without the corpus operators."""

import ast
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [("scoreweave/llm", "tests/llm"), ("scoreweave/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_and_collection_without_the_folder(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: {n for n in names if n in (".git", "__pycache__", "spark-warehouse") or os.path.relpath(os.path.join(d, n), ROOT) in gone})
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.splitlines()
    for names in map(str.split, said[-2:]):
        assert "impute_bivariate" in names and not [n for n in names if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout


def test_nothing_imports_the_folder():
    for folder, _, files in os.walk(f"{ROOT}/scoreweave"):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in files:
            if name.endswith(".py"):
                for node in ast.walk(ast.parse(open(f"{folder}/{name}").read())):
                    told = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module or ''}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in t.split(".") for t in told), f"{folder}/{name}"
