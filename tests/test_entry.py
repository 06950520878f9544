"""The driver's entry without the training-data package, or what it needs."""

import os
import subprocess
import sys

import pytest

import checks.queries

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""


@pytest.mark.parametrize("name", ["runlens.llm", "corpus_pipeline", "public_tokenizers"])
def test_entry_without(name):
    run = subprocess.run(
        [sys.executable, "-c", HIDE.format(name=name)], cwd=TOP, capture_output=True, text=True, timeout=120
    )
    counts = f"{len(checks.queries.QUERIES)} {len(checks.queries.ORACLES)}"
    assert run.stdout.strip() == counts, run.stderr
