"""The registered queries and their DuckDB counterparts fit together, and nothing needs the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__
from linkrisk.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_every_counterpart_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_the_rest_imports_without_the_corpus_operators():
    code = """
import sys
sys.modules["linkrisk.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert "u01_u09_normalize_url" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
