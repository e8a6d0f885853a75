"""Every query that SQL can express, against DuckDB at the smallest scale."""

import pytest
from compare import connect, difference

from hitlens.plans.file_oracles import ORACLES as FILE_ORACLES
from hitlens.plans.oracles import ORACLES as BASE_ORACLES
from hitlens.plans.queries import QUERIES

ORACLES = BASE_ORACLES | FILE_ORACLES
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert difference(spark, QUERIES[name], ORACLES[name], SF, con) is None


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
