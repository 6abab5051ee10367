"""The entry points on a copy of the library with and without its training-data part."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), set(s) <= set(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


def asked(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    if done.returncode:
        raise RuntimeError(done.stderr)
    return done.stdout.split()


@pytest.mark.parametrize("left", ["nothing", "caches"])
def test_entry_points_without_the_training_data_part(tmp_path, left):
    for name in ("__spark_entry__.py", "barloom"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    if left == "caches":
        (tmp_path / "barloom/llm/__pycache__").mkdir(parents=True)
    queries, sql, known, numbered, pipeline = asked(tmp_path)
    assert int(queries) > 110 and int(sql) > 105 and (known, numbered, pipeline) == ("True", "False", "False")


def test_a_broken_operator_is_no_missing_one(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "barloom/llm").mkdir()
    (tmp_path / "barloom/llm/__init__.py").write_text("")
    (tmp_path / "barloom/llm/queries.py").write_text("import no_such_library\n")
    with pytest.raises(RuntimeError, match="no_such_library"):
        asked(tmp_path)
