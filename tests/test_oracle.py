"""Every registered query of the library against its SQL, on whole tables."""

import pytest
from harness import DATA, difference

from sextant import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert not difference(spark, name, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(SQL)
