"""Session helpers: settings that suit these jobs, and the shared folder for written tables."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Target size of one shuffle partition; adaptive execution merges smaller ones.
SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024

_local_folders: dict[str, str] = {}


def shuffle_partitions(shuffle_bytes: int, cores: int) -> int:
    """Initial shuffle partitions for a job that shuffles ``shuffle_bytes``.

    At least one per core, otherwise about 128 MB each. Adaptive execution coalesces the
    small ones, so the number only has to be large enough.
    """
    return max(cores, math.ceil(shuffle_bytes / SHUFFLE_PARTITION_BYTES))


def settings(cores: int, shuffle_bytes: int = 0) -> dict[str, str]:
    """Spark SQL settings the jobs of this package are tuned for."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions(shuffle_bytes, cores)),
        "spark.sql.sources.partitionOverwriteMode": "static",
    }


def local_session(cores: int = 8, app: str = "retally", **conf: str) -> SparkSession:
    """A single-machine session for tests and timing."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**settings(cores), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may leave it unset; it then gets a temporary folder of its
    own, the same one on every call.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app_id = context.applicationId
    if app_id not in _local_folders:
        _local_folders[app_id] = tempfile.mkdtemp(prefix="retally-")
    return _local_folders[app_id]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that all that uses it sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
