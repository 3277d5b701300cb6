"""Change feeds: folders of change records that a stream follows from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHANGE

# One-letter operation codes that database capture tools write.
OP_CODES = {"r": "snapshot", "c": "insert", "u": "update", "d": "delete"}


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All change records of a folder."""
    return spark.read.schema(CHANGE).format(fmt).load(path)


def stream_changes(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Change records as they arrive. ``max_files`` bounds a micro-batch, for example while
    a large snapshot is taken in; the position is kept in the stream's checkpoint."""
    reader = spark.readStream.schema(CHANGE).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def write_changes(changes: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add change records to a folder."""
    changes.select(*CHANGE.fieldNames()).write.mode("append").format(fmt).save(path)


def decode(messages: DataFrame, column: str = "value") -> DataFrame:
    """Change records from JSON text or bytes, for example the ``value`` of a message queue.

    The JSON has the fields of a change record; the operation may be a one-letter code. NULL
    values, which queues keep after a delete, and empty ones carry no change and are left out;
    a message that is not valid JSON fails the job. Works on streams.
    """
    text = F.col(column).cast("string")
    parsed = messages.where(F.length(text) > 0).select(F.from_json(text, CHANGE, {"mode": "FAILFAST"}).alias("_c"))
    records = parsed.select("_c.*")
    names = F.create_map(*[F.lit(x) for pair in OP_CODES.items() for x in pair])
    return records.withColumn("op", F.coalesce(F.try_element_at(names, F.col("op")), F.col("op")))
