import pytest

from tidemill.plans.queries import ORACLE_SQL, QUERIES

from .parity import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF_DIR))
    assert got[1]
    assert got == sql_rows(con, ORACLE_SQL[name])


def stages(df):
    """Shuffles and scans of a query's plan, with no table broadcast."""
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    return plan.count("Exchange hashpartitioning"), plan.count("FileScan parquet")


def test_download_plan_reads_and_parses_the_metadata_once(spark):
    # lines by order, streams by video, orders twice: as distinct rows and by video
    assert stages(QUERIES["q51_download_plan"](spark, SF_DIR)) == (4, 2)


def test_download_summary_shuffles_as_the_plan_does_and_its_counts(spark):
    assert stages(QUERIES["q52_download_summary"](spark, SF_DIR)) == (5, 2)
