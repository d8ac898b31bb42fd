"""The driver's contract, with and without the optional operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 7


def test_the_rest_works_without_the_optional_operators(tmp_path):
    shutil.copytree(f"{ROOT}/kgspark", tmp_path / "kgspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_nothing_else_imports_the_optional_operators():
    for folder, _, names in os.walk(f"{ROOT}/kgspark"):
        if not folder.startswith(f"{ROOT}/kgspark/llm"):
            for name in names:
                if name.endswith(".py"):
                    assert "kgspark.llm" not in open(f"{folder}/{name}").read()
