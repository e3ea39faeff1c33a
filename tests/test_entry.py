"""The driver contract in __spark_entry__.py."""

import importlib.util
import os
import re

from pressferry.queries import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_runs_flagship_on_smoke_data(spark):
    e = load_entry()
    df = e.entry(spark)
    assert df.count() == 200
    assert df.columns[:3] == ["id", "post_author", "post_date"]


def test_queries_and_oracles_align():
    e = load_entry()
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and "SELECT" in s.upper() for s in o.values())
    own = {k for k in q if k != "pipeline" and not re.match(r"op\d+_", k)}
    assert own == set(queries())
    assert own <= set(o)
