"""The entry point with and without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/schemaloom", tmp_path / "schemaloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'rename_greedy' in q and 'pipeline' not in q and set(s) <= set(q), sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(f"{ROOT}/schemaloom"):
        if "llm" not in top:
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"^\s*(from|import)\s.*\bllm\b", open(f"{top}/{name}").read(), re.MULTILINE), name
