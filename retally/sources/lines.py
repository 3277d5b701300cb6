"""Positions in text input: data lines, line numbers and dense row numbers without a global sort.

Every row carries the file and the start of the input split it came from. The first line of a
file is known by its place: the scan numbers its rows, a pass over them finds the first number of
each file, and rows with these numbers are left out by a join on one 64-bit column. Row numbers come from one aggregate of
rows per split and prefix sums of two levels, splits inside a file and files inside ranges of
names, so no task sees all splits. The scan is the same in both passes, so the numbers are
reproducible when a task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

SPLIT = ["file", "split_start"]


def _text_lines(reader, path: str) -> DataFrame:
    lines = reader.option("lineSep", "\n").text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder: ``value``, ``file``, ``split_start``.

    Only a newline ends a line; a carriage return stays in the text.
    """
    return _text_lines(spark.read, path)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same columns from a folder that new files arrive in."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _text_lines(reader, path)


#: First lines that are sent to all tasks: eight bytes a file. With more files than that they are
#: found by a pass of their own over the lines of each split.
MOST_FILES = 1_000_000


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines without the first line of each file, whatever it says.

    Runs a pass over the lines that counts them by file. Steps stay narrow, so rows keep the order of
    the scan. In a stream this is for the batches (``maintain_from_lines``).
    """
    chosen = lines.select("value", *SPLIT)
    tagged = chosen.withColumn("_tag", F.monotonically_increasing_id())
    firsts = tagged.where("split_start = 0").groupBy("file").agg(F.min("_tag").alias("_tag")).select("_tag")
    firsts = written(firsts, "first-lines")
    if firsts.count() > MOST_FILES:
        return _without_first_rows(chosen)
    return tagged.join(F.broadcast(firsts), "_tag", "left_anti").select("value", *SPLIT)


def _without_first_rows(lines: DataFrame) -> DataFrame:
    """The same for any number of files: lines of a split arrive in order, so the first one of a
    split that starts at 0 is the file's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            codes = files.indices.to_numpy()
            first = np.ones(batch.num_rows, bool)
            first[1:] = (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])
            first[0] = (batch.column(1)[0].as_py(), int(starts[0])) != before
            before = (batch.column(1)[-1].as_py(), int(starts[-1]))
            yield batch.filter(pa.array(~(first & (starts == 0))))

    return lines.mapInArrow(run, lines.schema)


def _split_offsets(tagged: DataFrame, headed: bool = False) -> DataFrame:
    """Per split: its first tag and the rows in all splits before it. Runs the counting pass. With
    ``headed`` the first row of a file does not count."""
    rows = F.count(F.lit(1)) - F.when(F.lit(headed) & (F.col("split_start") == 0), 1).otherwise(0)
    counts = tagged.groupBy(*SPLIT).agg(rows.alias("_rows"), F.min("_tag").alias("_first_tag"))
    splits = written(counts, "splits")
    files = splits.groupBy("file").agg(F.sum("_rows").alias("_file_rows"))
    ranges = files.repartitionByRange("file").withColumn("_range", F.spark_partition_id())
    placed = written(ranges, "files")
    earlier = (Window.unboundedPreceding, -1)
    # One row per partition of a shuffle: as few as its setting says, whatever the input.
    totals = placed.groupBy("_range").agg(F.sum("_file_rows").alias("_range_rows"))
    before_range = F.sum("_range_rows").over(Window.orderBy("_range").rowsBetween(*earlier))
    totals = totals.select("_range", F.coalesce(before_range, F.lit(0)).alias("_before_range"))
    in_range = Window.partitionBy("_range").orderBy("file").rowsBetween(*earlier)
    before_file = F.coalesce(F.sum("_file_rows").over(in_range), F.lit(0))
    files = placed.withColumn("_in_range", before_file).join(totals, "_range")
    in_file = Window.partitionBy("file").orderBy("split_start").rowsBetween(*earlier)
    located = splits.withColumn("_in_file", F.coalesce(F.sum("_rows").over(in_file), F.lit(0))).join(files, "file")
    before = F.col("_before_range") + F.col("_in_range") + F.col("_in_file")
    return written(located.select(*SPLIT, "_first_tag", before.alias("_before")), "offsets")


def number_rows(rows: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Rows with a gapless number ``name`` from ``start``, in order of files and lines.

    Rows must still carry ``file`` and ``split_start`` and come from a scan through narrow
    steps only. The offsets, one row per split, are joined without a hint: Spark sends them
    to the rows while they are small.
    """
    tagged = rows.withColumn("_tag", F.monotonically_increasing_id())
    located = tagged.join(_split_offsets(tagged), SPLIT)
    number = F.lit(start) + F.col("_before") + F.col("_tag") - F.col("_first_tag")
    return located.withColumn(name, number).drop("_tag", "_first_tag", "_before")


def number_lines(lines: DataFrame) -> DataFrame:
    """Data lines with their position ``data_no`` from 0."""
    tagged = lines.select("value", *SPLIT).withColumn("_tag", F.monotonically_increasing_id())
    located = tagged.join(_split_offsets(tagged, headed=True), SPLIT)
    first, place = F.col("split_start") == 0, F.col("_tag") - F.col("_first_tag")
    number = F.col("_before") + place - F.when(first, 1).otherwise(0)
    data = located.where(~(first & (place == 0)))
    return data.withColumn("data_no", number).select("value", *SPLIT, "data_no")


def slice_lines(lines: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """``limit`` data lines from position ``offset`` on, counted before any line is dropped."""
    numbered = number_lines(lines).filter(F.col("data_no") >= offset)
    if limit is not None:
        numbered = numbered.filter(F.col("data_no") < offset + limit)
    return numbered.drop("data_no")
