"""The library works where the training-data folders are deleted."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names and len(names) > 80, len(names)
assert not [n for n in names if n == "pipeline" or n.startswith("op")  and n[2:3].isdigit()], names
import importlib, pkgutil, sitelens
for m in pkgutil.walk_packages(sitelens.__path__, "sitelens."):
    importlib.import_module(m.name)
"""


def test_every_module_imports_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/sitelens", tmp_path / "sitelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert not done.returncode, done.stderr[-2000:]


def test_nothing_outside_names_llm():
    for folder, _, files in os.walk(f"{ROOT}/sitelens"):
        if "/llm" not in folder:
            for name in (f for f in files if f.endswith(".py")):
                with open(f"{folder}/{name}") as f:
                    assert "llm" not in [w for line in f if line.lstrip().startswith(("import ", "from ")) for w in line.replace(".", " ").split()], (folder, name)
