"""Fixed schemas: events, change records, the view log and the change notices."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "globaleventid"

#: The 17 columns of an input line in file order: name, type, may be NULL.
LINE_FIELDS = [
    ("event_date", T.IntegerType(), False),
    ("source_actor", T.StringType(), False),
    ("target_actor", T.StringType(), False),
    ("cameo_code", T.StringType(), False),
    ("num_events", T.IntegerType(), False),
    ("num_articles", T.IntegerType(), False),
    ("quad_class", T.IntegerType(), False),
    ("goldstein", T.DoubleType(), True),
    ("source_geo_type", T.IntegerType(), True),
    ("source_geo_lat", T.DoubleType(), True),
    ("source_geo_long", T.DoubleType(), True),
    ("target_geo_type", T.IntegerType(), True),
    ("target_geo_lat", T.DoubleType(), True),
    ("target_geo_long", T.DoubleType(), True),
    ("action_geo_type", T.IntegerType(), True),
    ("action_geo_lat", T.DoubleType(), True),
    ("action_geo_long", T.DoubleType(), True),
]

GEO_COLUMNS = [name for name, _, _ in LINE_FIELDS if "_geo_" in name]
REQUIRED_COLUMNS = [name for name, _, nullable in LINE_FIELDS if not nullable]

#: One event. Spark keeps no NOT NULL on data it reads, so all columns are declared nullable
#: and the loader checks the required ones.
EVENT = T.StructType(
    [T.StructField(KEY, T.LongType())] + [T.StructField(name, kind) for name, kind, _ in LINE_FIELDS]
)
EVENT_COLUMNS = EVENT.fieldNames()

#: One change of the event table. ``before`` is set for update and delete, ``after`` for
#: snapshot, insert and update.
CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("before", EVENT),
        T.StructField("after", EVENT),
    ]
)

#: One group of one view in one batch: the keys of all views (NULL where a view lacks the
#: key) and what the batch adds to the group's sums.
DELTA = T.StructType(
    [
        T.StructField("event_date", T.IntegerType()),
        T.StructField("quad_class", T.IntegerType()),
        T.StructField("source_actor", T.StringType()),
        T.StructField("target_actor", T.StringType()),
        T.StructField("cameo_code", T.StringType()),
        T.StructField("d_events", T.LongType()),
        T.StructField("d_articles", T.LongType()),
        *[T.StructField(f"d_score_{n}", T.LongType()) for n in range(6)],
        T.StructField("d_scored", T.LongType()),
        T.StructField("d_rows", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("view", T.StringType()),
    ]
)

#: What a batch leaves of one key: the row, or that it is deleted.
IMAGE = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        T.StructField("event", EVENT),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

#: A text line that is no event, and its first bad field.
REJECT = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

#: One row per view and batch: what a commit record tells readers.
NOTICE = T.StructType(
    [
        T.StructField("view", T.StringType()),
        T.StructField("keys_changed", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("feed", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
