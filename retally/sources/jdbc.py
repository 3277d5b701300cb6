"""Tables of an external database over JDBC, read in parallel by key range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    parts: int = 16,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table. With an integer ``key`` and its ``bounds`` the read is split into
    ``parts`` ranges (rows outside the bounds go to the outer ranges); without, one task
    reads it all, which suits small result tables only."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    if key is not None:
        if bounds is None:
            raise ValueError("a key needs its bounds")
        reader = (
            reader.option("partitionColumn", key)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", parts)
        )
    return reader.load()


def write_table(
    df: DataFrame, url: str, table: str, mode: str = "append", properties: dict[str, str] | None = None
) -> None:
    """Write rows to a database table; Spark appends or overwrites, it does not upsert."""
    writer = df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
    for name, value in (properties or {}).items():
        writer = writer.option(name, value)
    writer.save()
