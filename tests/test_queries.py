"""Every registered query of the core library beside its SQL, or at least run, on the small set."""

import oracle
import pytest
from oracle import SMALL

from quillmark.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return oracle.tables(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SMALL), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_contract_without_the_text_subpackage(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
