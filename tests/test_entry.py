"""The driver contract, and that it holds where the optional parts are missing."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
from loglens.plans import catalog
assert set(e.queries()) == set(catalog.QUERIES), set(e.queries()) ^ set(catalog.QUERIES)
assert set(e.oracle_sql()) <= set(e.queries())
"""


def hidden(name):
    done = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_without_the_tokenizers_package_the_other_queries_are_there():
    hidden("public_tokenizers")


def test_without_the_subpackage_the_other_queries_are_there():
    hidden("loglens.llm")
    hidden("corpus_pipeline")


def test_every_query_is_callable_and_every_sql_has_its_query():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert all(callable(f) for f in queries.values()) and set(sql) <= set(queries)
