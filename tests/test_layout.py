"""The subpackage of training-data operators stands alone, and without it the rest still works."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_subpackage():
    for p in (ROOT / "inkmill").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "inkmill").parts:
            assert "inkmill.llm" not in p.read_text() and "import llm" not in p.read_text(), p


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "inkmill", tmp_path / "inkmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('p1_') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
