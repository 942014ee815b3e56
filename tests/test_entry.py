"""The entry module with the training-data subpackage gone."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_operators(tmp_path):
    """The pipeline's file stays, its subpackage is deleted, and an empty folder of that name is left behind."""
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 40
