"""The entry module can be imported before a session exists, and with or without the subpackage llm."""

import subprocess
import sys

from conftest import ROOT


def test_imports_without_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_imports_without_llm():
    code = """
import sys, importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name in ('rankcut.llm', 'corpus_pipeline') else real(name, *a)
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']
assert not [n for n in sys.modules if n.startswith('rankcut.llm')]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_gives_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "ndcg" in df.columns
