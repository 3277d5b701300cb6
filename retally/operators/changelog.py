"""Change records of a keyed table, and the signed rows that views are kept from.

A record holds the row before and after the change. As signed rows (-1 for before, +1 for
after) any set of records adds up: sums, counts and averages need nothing else, so
retractions, moved keys and late rows are no special cases and the order does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT, KEY

OPS_WITH_BEFORE = ("update", "delete")
OPS_WITH_AFTER = ("snapshot", "insert", "update")


def _event(columns: list[str]) -> Column:
    """The row as an event struct, NULL for the event columns it lacks."""
    fields = [
        f"cast({f.name if f.name in columns else 'NULL'} as {f.dataType.simpleString()}) as {f.name}"
        for f in EVENT.fields
    ]
    return F.expr(f"struct({', '.join(fields)})")


@dataclass(frozen=True)
class Change:
    """One kind of change: which rows it happens to and the images it leaves.

    ``before`` and ``after`` hold the values that differ from the row (``{}`` for the row as
    it is, None for no image). ``seq`` is the position in the feed; it only has to order the
    changes of one key, and defaults to the key.
    """

    op: str
    before: dict[str, Column] | None = None
    after: dict[str, Column] | None = None
    where: Column | None = None
    seq: Column | None = None


def _record(change: Change) -> list[Column]:
    def image(new_values: dict[str, Column] | None) -> Column:
        if new_values is None:
            return F.lit(None).cast(EVENT)
        result = F.col("_row")
        for name, value in new_values.items():
            result = result.withField(name, value.cast(EVENT[name].dataType))
        return result

    return [
        (F.col(KEY) if change.seq is None else change.seq).cast("long").alias("seq"),
        F.lit(change.op).alias("op"),
        image(change.before).alias("before"),
        image(change.after).alias("after"),
    ]


def records(rows: DataFrame, *changes: Change) -> DataFrame:
    """Change records of several kinds of change, from one pass over the rows."""
    with_row = rows.select("*", _event(rows.columns).alias("_row"))
    if len(changes) == 1:
        change = changes[0]
        chosen = with_row if change.where is None else with_row.filter(change.where)
        return chosen.select(*_record(change))
    made = [
        F.struct(*_record(c)) if c.where is None else F.when(c.where, F.struct(*_record(c)))
        for c in changes
    ]
    return with_row.select(F.inline(F.array_compact(F.array(*made))))


def snapshot_records(rows: DataFrame) -> DataFrame:
    """The present content of a table as records, to start a feed with."""
    return records(rows, Change("snapshot", after={}))


def insert_records(rows: DataFrame) -> DataFrame:
    """New rows as records."""
    return records(rows, Change("insert", after={}))


def delete_records(rows: DataFrame, seq: Column | None = None) -> DataFrame:
    """Deleted rows (as they were) as records."""
    return records(rows, Change("delete", before={}, seq=seq))


def update_records(old: DataFrame, new: DataFrame, seq: Column | None = None) -> DataFrame:
    """Rows of ``old`` and ``new`` with the same key as records; others are left out."""
    before = old.select(KEY, _event(old.columns).alias("before"))
    after = new.select(KEY, _event(new.columns).alias("after"))
    return before.join(after, KEY).select(
        (F.col(KEY) if seq is None else seq).cast("long").alias("seq"),
        F.lit("update").alias("op"),
        "before",
        "after",
    )


def signed_rows(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Change records as rows of ``columns`` with a ``sign``: -1 leaves, +1 enters.

    Only the named fields are read from the feed. A record that lacks the image its
    operation needs, or has an unknown operation, fails the job: dropping it would leave the
    views wrong.
    """
    op = F.col("op")
    kind = T.StructType([EVENT[c] for c in columns])

    def image(name: str, needed: Column) -> Column:
        missing = needed & F.col(name).isNull()
        message = F.concat(F.lit(f"change record without {name}: seq "), F.col("seq").cast("string"))
        slim = F.struct(*[F.col(f"{name}.{c}").alias(c) for c in columns])
        return F.when(missing, F.raise_error(message).cast(kind)).when(needed, slim)

    known = op.isin(*OPS_WITH_BEFORE, *OPS_WITH_AFTER)
    message = F.concat(F.lit("unknown change operation: "), F.coalesce(op, F.lit("NULL")))
    checked = changes.filter(
        F.when(known, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )
    pairs = checked.select(
        image("before", op.isin(*OPS_WITH_BEFORE)).alias("b"),
        image("after", op.isin(*OPS_WITH_AFTER)).alias("a"),
    )
    stacked = pairs.select(F.expr("stack(2, -1, b, 1, a) as (sign, r)"))
    kept = stacked.filter(F.col("r").isNotNull())
    return kept.select("sign", *[F.col(f"r.{c}").alias(c) for c in columns])


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after the changes; of several changes of one key the last one counts.

    The last image per key is found by an aggregate that combines before the shuffle, so a
    key with very many changes does not end up in one task.
    """
    key = F.coalesce(F.col("after")[KEY], F.col("before")[KEY])
    last = changes.groupBy(key.alias(KEY)).agg(
        F.max_by(F.struct(F.col("after")), "seq").alias("last")
    )
    image = F.col("last.after")
    kept = base.join(last.select(KEY), KEY, "left_anti")
    entered = last.filter(image.isNotNull()).select(*[image[c].alias(c) for c in base.columns])
    return kept.unionByName(entered)
