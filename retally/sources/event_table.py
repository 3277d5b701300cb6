"""The stored event table: Parquet, by month, ordered by date inside each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT, KEY

_STORED = T.StructType([*EVENT.fields, T.StructField("event_month", T.IntegerType())])


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write events; ``mode='overwrite'`` replaces the table, ``'append'`` adds to it.
    Event columns that the rows lack are NULL.

    The rows are range-partitioned by date and id, so a very busy day is spread over several
    tasks instead of landing in one, and each task writes one or two months.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    given = {name: F.col(name) for name in events.columns}
    typed = events.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT]
    )
    by_month = typed.withColumn("event_month", (F.col("event_date") / 100).cast("int"))
    (
        by_month.repartitionByRange("event_date", KEY)
        .sortWithinPartitions("event_month", "event_date")
        .write.mode(mode)
        .partitionBy("event_month")
        .parquet(path)
    )


def read_events_table(spark: SparkSession, path: str) -> DataFrame:
    """The event table with its ``event_month`` partition column."""
    return spark.read.schema(_STORED).parquet(path)
