"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from sumforge.plans import catalogue
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES | catalogue.CHECKS))
def test_query(spark, con, name):
    df = (catalogue.QUERIES | catalogue.CHECKS)[name](spark, SF)
    if name in catalogue.EXPECTED:
        assert differences(df, con, catalogue.EXPECTED[name]) == []
    else:
        assert df.count() > 0


def test_entry_point_works_without_the_optional_parts(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    for m in [m for m in sys.modules if m.startswith("sumforge.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "sumforge.llm", None)
    monkeypatch.setitem(sys.modules, "sumforge.llm.queries", None)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLE_SQL)
    assert entry.entry(spark).count() == 10
