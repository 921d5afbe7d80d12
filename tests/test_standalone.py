"""The library without its training-data subpackage: everything else imports and registers."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_queries_without_the_subpackage(tmp_path, with_pipeline):
    shutil.copytree(os.path.join(ROOT, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'hybrid_search' in q and set(s) <= set(q); assert not any(n == 'pipeline' or n.startswith('op1_') for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
