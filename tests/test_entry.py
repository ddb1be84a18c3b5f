"""The entry module works with and without the optional subpackage."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_catalogue():
    from corpusloom.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) >= 50


def test_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpusloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_core_does_not_import_it():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"corpusloom\.llm|from \.+llm", p.read_text()), p


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
