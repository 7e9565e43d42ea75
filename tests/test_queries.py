"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from terrafold.plans.registry import QUERIES, SQL
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        same(spark, QUERIES[name], SQL[name], SF)
    else:
        df = QUERIES[name](spark, SF)  # its rows are compared with a plain version's in test_sequences
        assert df.columns and (df.count() > 0 or name == "agg13_instances")


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
