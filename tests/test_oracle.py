"""Every registered query of the library against its oracle, over whole tables."""

import os

import pytest

from foliant.plans import catalog
from oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()
#: Without SQL; where each is held against a plain version over whole tables.
PLAIN = {
    "chunk_recursive": "test_operators.py", "chunk_stats": "test_operators.py", "conv_messages_whole": "test_operators.py", "quantised_search": "test_quantised.py",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) == ""
    else:
        assert name in PLAIN and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
