"""The training-data operators can be deleted without a trace."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "siltstone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "siltstone").parts:
            assert not re.search(r"(?:import|from)\s+[\w.]*\bllm\b", p.read_text()), p


def test_entry_works_without_it(tmp_path):
    shutil.copytree(ROOT / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
