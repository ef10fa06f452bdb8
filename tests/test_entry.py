"""The entry module, with the corpus operators and without them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part(tmp_path):
    names = ["__spark_entry__.py", "tallyspark"]
    for n in names:
        (shutil.copytree if (REPO / n).is_dir() else shutil.copy)(REPO / n, tmp_path / n)
    shutil.rmtree(tmp_path / "tallyspark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'e01_episodes' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_only_the_entry_names_the_optional_part():
    for p in (REPO / "tallyspark").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "tallyspark.llm" not in p.read_text()
