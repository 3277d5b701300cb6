"""A third of all order lines on one order, supplier and part: joins are split, results exact."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare

SOURCE = "/root/testdata/sf0.001"

SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def hot_tables(spark, tmp_path_factory):
    """The given tables, with a third of the lines moved to one order, supplier and part."""
    folder = str(tmp_path_factory.mktemp("hot"))
    for name in ("orders", "customer", "supplier", "part", "events"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{SOURCE}/lineitem.parquet").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(5)))
    )
    hot = F.xxhash64("l_orderkey", "l_linenumber", "copy") % 3 == 0
    keys = ("l_orderkey", "l_suppkey", "l_partkey")
    moved = lines.withColumns({k: F.when(hot, F.lit(1)).otherwise(F.col(k)) for k in keys})
    moved.drop("copy").repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL_PARTITIONS}
    for key, value in SMALL_PARTITIONS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", ["view_dyad", "view_cameo", "raw_dyads", "recompute_actor"])
def test_hot_keys(spark, hot_tables, small_partitions, name):
    connection = compare.duckdb.connect()
    for table in ("orders", "customer", "supplier", "part", "events", "lineitem"):
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{hot_tables}/{table}.parquet/*.parquet')"
        )
    df = entry.queries()[name](spark, hot_tables)
    columns, rows = compare.spark_rows(df)
    assert (columns, rows) == compare.sql_rows(connection, entry.oracle_sql()[name])
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in final
