import os

import pytest

from auditweave.llm.queries import ORACLE_SQL, QUERIES
from tests.duck import both

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_duckdb(spark, name):
    ours, theirs = both(spark, SF, QUERIES[name], ORACLE_SQL[name])
    assert ours == theirs


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
