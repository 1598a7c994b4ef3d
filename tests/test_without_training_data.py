"""The library without its training-data subpackage: a copy with both folders deleted still imports and answers."""

import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

SCRIPT = """
import sys
import __spark_entry__ as contract
names = set(contract.queries())
assert len(names) > 60 and set(contract.oracle_sql()) <= names, names
print(" ".join(sorted(names)))
"""


def names_in(folder) -> set[str]:
    ran = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin", "PYTHONPATH": str(folder)})
    assert ran.returncode == 0, ran.stderr
    return set(ran.stdout.split())


@pytest.mark.parametrize("pipeline", [True, False])
def test_a_copy_without_training_data_keeps_every_other_query(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "spark-warehouse"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    import __spark_entry__ as contract

    own = {name for name in contract.queries() if not name.startswith("op") or not name[2:3].isdigit()} - {"pipeline"}
    assert names_in(copy) == own
    assert not [p for p in (copy / "parcelry").rglob("*.py") if "parcelry.llm" in p.read_text(encoding="utf-8")]
