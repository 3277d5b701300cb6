"""The given tables as events: input for the registered queries, tests and timing.

``keyed_events`` maps the event log one to one (it has a key). ``line_events`` maps order
lines (larger, no key) and joins only the tables that the wanted columns come from; the joins
are left joins on unique keys, so each line stays exactly one event whichever columns are
asked for.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import to_ymd
from .schemas import EVENT, KEY

EVENT_LOG_COLUMNS = [
    KEY,
    "event_date",
    "source_actor",
    "target_actor",
    "cameo_code",
    "num_events",
    "num_articles",
    "quad_class",
    "goldstein",
]

# Event code and class of each kind of logged event.
CODES = {"view": "010", "click": "043", "signup": "050", "purchase": "112"}
CLASSES = {"view": 1, "click": 1, "signup": 2, "purchase": 3}


# The columns used of the given tables. Declared, so that no job has to read a
# file footer before a query is planned.
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
    " l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "part": "p_partkey long, p_type string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, with the columns used here."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def _switch(column: Column, values: dict, other) -> Column:
    result = None
    for key, value in values.items():
        hit = column == key
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result.otherwise(other)


def _score(number: Column, missing: Column) -> Column:
    """A score from -10 to 10 in tenths from a whole number."""
    return F.when(~missing, (number % F.lit(201) - F.lit(100)) / F.lit(10.0))


def keyed_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as events with a key."""
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    actor = F.concat(F.lit("A"), (F.lit(10) + user % F.lit(90)).cast("string"))
    return table(spark, folder, "events").select(
        event.alias(KEY),
        to_ymd(F.col("ts")).alias("event_date"),
        F.when(user % F.lit(11) == 0, F.concat(actor, F.lit("GOV")))
        .otherwise(actor)
        .alias("source_actor"),
        F.concat(F.lit("A"), (F.lit(10) + event % F.lit(90)).cast("string")).alias("target_actor"),
        _switch(kind, CODES, "190").alias("cameo_code"),
        (F.lit(1) + event % F.lit(3)).cast("int").alias("num_events"),
        (F.lit(1) + user % F.lit(10)).cast("int").alias("num_articles"),
        _switch(kind, CLASSES, 4).alias("quad_class"),
        _score(F.floor(F.col("value") * F.lit(100)), event % F.lit(17) == 0).alias("goldstein"),
    )


def _nation_code(nation_key: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(nation_key.cast("string"), 2, "0"))


def line_events(
    spark: SparkSession, folder: str, *columns: str, dates: tuple[int, int] | None = None
) -> DataFrame:
    """Order lines as events, with the named columns only.

    The event date is computed from a timestamp here, so a range of it would not reach the
    scan; ``dates`` puts the same range on the timestamp.
    """
    lines = table(spark, folder, "lineitem")
    if dates is not None:
        first, last = (F.lit(datetime.strptime(str(d), "%Y%m%d").date()) for d in dates)
        shipped = F.col("l_shipdate")
        after = F.date_add(last, 1).cast("timestamp_ntz")
        lines = lines.filter((shipped >= first.cast("timestamp_ntz")) & (shipped < after))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    derived = {
        "event_date": to_ymd(F.col("l_shipdate")),
        "source_actor": _nation_code(F.col("c_nationkey")),
        "target_actor": _nation_code(F.col("s_nationkey")),
        "cameo_code": F.col("p_type"),
        "num_events": line,
        "num_articles": F.col("l_quantity").cast("int"),
        "quad_class": F.when(flag == "A", 1)
        .when(flag == "R", 4)
        .when(status == "O", 2)
        .otherwise(3),
        "goldstein": _score(part * F.lit(7) + line, part % F.lit(17) == 0),
    }
    if "source_actor" in columns:
        customers = table(spark, folder, "customer")
        buyers = (
            table(spark, folder, "orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("o_orderkey", "c_nationkey")
        )
        lines = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "target_actor" in columns:
        suppliers = table(spark, folder, "supplier")
        lines = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if "cameo_code" in columns:
        parts = table(spark, folder, "part")
        lines = lines.join(parts, part == F.col("p_partkey"), "left")
    return lines.select(*[derived[c].alias(c) for c in columns])


# The four sample events a new table starts with.
_NOWHERE = (None,) * 9
SEED_ROWS = [
    (1, 19790101, "AFR", "FRA", "043", 1, 4, 1, 2.8, *_NOWHERE),
    (2, 19790101, "AFR", "FRA", "050", 2, 9, 1, 3.5, *_NOWHERE),
    (3, 19790101, "ARG", "CHL", "172", 2, 4, 4, -5.0)
    + (1, -34.0, -64.0, 1, -30.0, -71.0, 1, -34.0, -64.0),
    (4, 19790101, "CHN", "CHNGOV", "0841", 1, 6, 2, 7.0, *((4, 39.9289, 116.388) * 3)),
]


def seed_events(spark: SparkSession) -> DataFrame:
    """The sample events; add them with ``operators.keyed.insert_ignore``."""
    return spark.createDataFrame(SEED_ROWS, EVENT)
