"""The contract's module, with and without the folder of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    for name in ("seqloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "seqloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'word_counts' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, timeout=120)


def test_nothing_else_imports_the_llm_folder():
    for p in (ROOT / "seqloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "seqloom.llm" not in p.read_text() and ".llm" not in p.read_text()
