"""Tables over JDBC, in the database that comes with Spark."""

import pytest
from pyspark.sql import functions as F

from talentloom.sources import marketplace

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("log") / "derby.log"))
    address = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    # most ids are small, a few far away
    rows = spark.range(1000).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("id"), F.concat(F.lit("job "), F.col("id").cast("string")).alias("title"), (F.col("id") % 7).alias("company_id"))
    rows.coalesce(1).write.jdbc(address, "jobs", properties=DRIVER)
    spark.range(0).select("id").write.jdbc(address, "empty_jobs", properties=DRIVER)
    return address


def sizes(df):
    return sorted((r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()), reverse=True)


def test_a_table_is_read_whole(spark, url):
    whole = marketplace.read_jdbc(spark, url, "jobs", options=DRIVER)
    split = marketplace.read_jdbc(spark, url, "jobs", "id", (0, 999_000_001), 8, DRIVER)
    even = marketplace.read_jdbc_evenly(spark, url, "jobs", "id", 8, options=DRIVER)
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 1000 and sorted(map(tuple, split.collect())) == want == sorted(map(tuple, even.collect()))
    # equal ranges leave nearly all rows to one task
    assert sizes(split)[0] >= 990 and len(sizes(even)) == 8 and sizes(even)[0] <= 140


def test_filters_and_columns_are_pushed(spark, url):
    rows = marketplace.read_jdbc_evenly(spark, url, "jobs", "id", 4, options=DRIVER).filter("company_id = 3 AND id < 100").select("title")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(COMPANY_ID,3)" in plan.replace("company_id", "COMPANY_ID") and "ReadSchema: struct<title:string>" in plan.lower().replace("readschema", "ReadSchema")
    assert rows.count() == 14


def test_an_empty_table(spark, url):
    assert marketplace.read_jdbc_evenly(spark, url, "empty_jobs", options=DRIVER).count() == 0


def test_conditions_part_all_keys():
    assert marketplace.even_ranges("id", [5.0, 5.0, 9.0]) == ["id < 5 OR id IS NULL", "id >= 5 AND id < 9", "id >= 9"]
    assert marketplace.even_ranges("id", []) == ["1 = 1"]


def test_addresses():
    assert marketplace.jdbc_url("mysql+pymysql://u:p@h/db") == "jdbc:mysql://u:p@h/db" and marketplace.jdbc_url("jdbc:derby:x") == "jdbc:derby:x"
