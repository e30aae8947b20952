import pytest

from noctua.llm.queries import ORACLE, QUERIES
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name], SF)
