import os

import pytest

from auditweave.plans.catalog import ORACLE_SQL, QUERIES
from tests.duck import both

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_duckdb(spark, name):
    if name in ORACLE_SQL:
        ours, theirs = both(spark, SF, QUERIES[name], ORACLE_SQL[name])
        assert ours == theirs
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert {r.severity for r in e.entry(spark).collect()} == {"Critical", "High", "Medium", "Low", "Informational"}
