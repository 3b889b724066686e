import pytest

from tests.parity import connect, spark_rows, sql_rows
from tidemill.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_parity(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(connect(SF_DIR), ORACLE_SQL[name])
