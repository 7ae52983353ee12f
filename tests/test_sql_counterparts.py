import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from checks.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_check(spark, folder, connection, name):
    ok, note = compare(spark, connection, folder, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_entry_is_the_details_of_the_smallest_data(spark):
    frame = entry.entry(spark)
    assert "apply_changes" in frame.columns
    assert frame.count() > 0


def test_every_check_is_an_entry_point():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) == set(ORACLES)


def test_the_rest_works_without_the_operators_for_training_data(tmp_path):
    """A copy of the repository without them imports and offers the other queries."""
    root = Path(entry.__file__).parent
    for part in ("rowguard", "checks"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == len(e.oracle_sql()) and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
