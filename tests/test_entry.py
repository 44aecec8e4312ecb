"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["nation", "customers", "returned_parts"] and df.count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n[:2] == 'op' and n[2:3].isdigit() for n in q) and 'pipeline' not in q, list(q); import trailweave.session, trailweave.sources.store, trailweave.__main__"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)


def test_nothing_else_imports_them():
    for file in (ROOT / "trailweave").rglob("*.py"):
        if "llm" not in file.parts:
            assert "trailweave.llm" not in file.read_text(), file


def test_shell(tmp_path):
    text = "INSERT (:P {n: 1})\n:begin\nINSERT (:P {n: 2})\n:rollback\nMATCH (p) RETURN p.n AS n\nMATCH (p RETURN\n:quit\n"
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-m", "trailweave", "shell", f"store:file://{tmp_path}/s"], input=text, capture_output=True, text=True, env=env, cwd=tmp_path, timeout=300)
    assert done.stdout.splitlines() == ['{"ok": true, "rows_affected": 1}', '{"ok": true, "rows_affected": 1}', '[{"n": 1}]']
    assert "1:10: error: expected ')'" in done.stderr
