"""Every registered query of the reference's operators against its SQL in DuckDB, over the smallest tables."""

import pytest
from compare import duck_rows, spark_rows

from weftline import plans

plans.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert spark_rows(plans.QUERIES[name](spark, SF)) == duck_rows(plans.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
