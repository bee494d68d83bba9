import pytest

from sparkseries.queries import ORACLES, QUERIES
from tests.oracle_util import duck, same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, duck(ORACLES[name], SF))
    else:
        assert df.count() > 0
