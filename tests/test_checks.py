"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from checks import CHECKS
from tools.verify import compare, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_sql(spark, con, name):
    got = CHECKS[name].run(spark, SF).toPandas()
    if CHECKS[name].sql is not None:
        assert compare(got, con.execute(CHECKS[name].sql).df()).startswith("ok")
    assert len(got.columns) > 0
