"""One round of changes of the event log that exercises every kind of change at once.

Which rows change, and to what, follows from the table itself, so the amount of change grows
with it:

* purchases are re-scored (NULL scores get a value) and counted once more,
* clicks move to other groups of every view (code, class, actors swapped),
* sign-ups lose their score, which leaves groups without any,
* errors are deleted, which empties their groups,
* page views are inserted again decades earlier, under new keys,
* purchases are also inserted under new keys, updated and deleted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.changelog import Change, records
from ..operators.keyed import id_range, shift_ids
from ..schemas import KEY

# Codes of the kinds of logged events, and the code that clicks move to.
VIEW, CLICK, SIGNUP, PURCHASE, ERROR = "010", "043", "050", "112", "190"
MOVED_CODE, MOVED_CLASS = "042", 2


def has_code(code: str) -> Column:
    return F.col("cameo_code") == code


def rescored() -> dict[str, Column]:
    """New values of a purchase."""
    return {
        "goldstein": F.coalesce(-F.col("goldstein"), F.lit(1.0)),
        "num_events": F.col("num_events") + F.lit(1),
    }


def moved() -> dict[str, Column]:
    """New values of a click."""
    return {
        "cameo_code": F.lit(MOVED_CODE),
        "quad_class": F.lit(MOVED_CLASS),
        "source_actor": F.col("target_actor"),
        "target_actor": F.col("source_actor"),
    }


def unscored() -> dict[str, Column]:
    """New values of a sign-up."""
    return {"goldstein": F.lit(None).cast("double")}


def incremented() -> dict[str, Column]:
    """The score one higher, counting a missing one as 0."""
    return {"goldstein": F.coalesce(F.col("goldstein"), F.lit(0.0)) + F.lit(1.0)}


def late_rows(events: DataFrame, shift: int) -> DataFrame:
    """Page views again, one to three decades earlier, with keys shifted by ``shift``."""
    earlier = F.col("event_date") - F.lit(100000) * F.col("num_events")
    return shift_ids(events.filter(has_code(VIEW)).withColumn("event_date", earlier), shift)


def rescore_patch(events: DataFrame) -> DataFrame:
    """Key and new values of every purchase."""
    return events.filter(has_code(PURCHASE)).select(
        KEY, *[value.alias(name) for name, value in rescored().items()]
    )


def _kinds(events: DataFrame) -> dict[str, list[Change]]:
    low, high = id_range(events)
    width = high - low + 1

    def step(n: int) -> Column:
        return F.col(KEY) + F.lit(n * width)

    earlier = {"event_date": F.col("event_date") - F.lit(100000) * F.col("num_events")}
    fresh = {KEY: step(2)}
    purchase = has_code(PURCHASE)
    return {
        "rescore": [Change("update", {}, rescored(), purchase, step(3))],
        "move": [Change("update", {}, moved(), has_code(CLICK), step(3))],
        "unscore": [Change("update", {}, unscored(), has_code(SIGNUP), step(3))],
        "delete": [Change("delete", {}, None, has_code(ERROR), step(3))],
        "late": [Change("insert", None, {KEY: step(1), **earlier}, has_code(VIEW), step(3))],
        "transient": [
            Change("insert", None, fresh, purchase, step(3)),
            Change("update", fresh, fresh | moved(), purchase, step(4)),
            Change("delete", fresh | moved(), None, purchase, step(5)),
        ],
    }


def some_changes(events: DataFrame, kind: str) -> DataFrame:
    """The changes of one kind, as change records. Runs a query for the key range."""
    return records(events, *_kinds(events)[kind])


def all_changes(events: DataFrame) -> DataFrame:
    """All changes of the round as change records, from one pass over the table. Runs a
    query for the key range."""
    return records(events, *[change for kind in _kinds(events).values() for change in kind])


def many_digits(events: DataFrame) -> DataFrame:
    """The events with scores of many digits: thirds and sevenths, very small and large ones."""
    kind, score = F.col(KEY) % 4, F.col("goldstein")
    made = F.when(kind == 0, score / F.lit(7.0)).when(kind == 1, score * F.lit(1e-11)).when(kind == 2, score * F.lit(2500.0) / F.lit(3.0))
    return events.withColumn("goldstein", made.otherwise(score))


def odd_deletes(events: DataFrame) -> DataFrame:
    """Every second event deleted, as change records."""
    return records(events, Change("delete", {}, None, F.col(KEY) % 2 == 1))
