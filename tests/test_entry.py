"""The entry points with and without the folders that may be taken away."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q), set(o) <= set(q))"


def said(folder) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.strip()


@pytest.mark.parametrize("gone", [("postella/llm", "tests/llm"), ("postella/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_index_stands_without(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        at = tmp_path / "r" / name
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    n, oracles, pipeline, ops, known = said(tmp_path / "r").split()
    assert int(n) >= int(oracles) > 50 and pipeline == "False" and known == "True"
    assert ops == str("postella/llm" not in gone and os.path.isdir(os.path.join(ROOT, "postella/llm")))


def test_errors_inside_an_optional_module_are_not_hidden(tmp_path):
    shutil.copytree(os.path.join(ROOT, "postella"), tmp_path / "postella", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "postella/llm").mkdir()
    (tmp_path / "postella/llm/__init__.py").touch()
    (tmp_path / "postella/llm/queries.py").write_text("import no_such_library\n")
    with pytest.raises(subprocess.CalledProcessError):
        said(tmp_path)
