"""Every query registered outside the corpus subpackage against its SQL, on whole tables."""

import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
spec = importlib.util.spec_from_file_location("compare", os.path.join(ROOT, "tools", "compare.py"))
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)
entry = compare.load_entry()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("query", entry.REGISTERED, ids=lambda q: q.name)
def test_query_equals_sql(spark, duck, sf_dir, query):
    got = query.run(spark, sf_dir).toPandas()
    assert query.sql is not None
    assert compare.difference(got, duck.execute(query.sql).df()) is None
    assert len(got) > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
