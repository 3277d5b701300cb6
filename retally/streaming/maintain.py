"""Streaming queries that keep a view store current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import event_text
from ..sources.lines import data_lines
from .store import Clock, ViewStore, _now

#: At most two seconds between batches. A change that comes just after a batch began waits for it
#: and for its own: changes are to be visible within five to ten seconds, which holds while a
#: batch takes up to four.
DEFAULT_TRIGGER = {"processingTime": "2 seconds"}


def maintain(
    changes: DataFrame,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    compact_every: int | None = None,
    clock: Clock = _now,
    table: bool = False,
) -> StreamingQuery:
    """Start keeping the views under ``root`` current from a stream of change records, and with
    ``table`` the table they are of.

    There is no operator state: the checkpoint holds only the feed position, and each batch
    is one shuffle of its own changes. No watermark is used and nothing is dropped, so events
    of any age reach their groups. ``trigger={'availableNow': True}`` takes in what is there
    and stops. With ``compact_every`` the log is folded after every so many batches, before
    the next batch starts; ``ViewStore.compact`` in a job of its own does not hold up the
    stream. ``clock`` gives the time of a batch.
    """
    return _started(changes, ViewStore.apply, root, checkpoint, trigger, compact_every, clock, table)


def maintain_from_lines(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    compact_every: int | None = None,
    clock: Clock = _now,
    table: bool = False,
    layout: int = event_text.FULL,
) -> StreamingQuery:
    """The same from a stream of text lines (``lines.stream_lines``): events get ids that follow each
    other from batch to batch, lines with a bad field are kept as rejects of the same commit."""

    def append(store: ViewStore, batch: DataFrame, batch_id: int, feed: str) -> bool:
        return store.append_parsed(event_text.parse(data_lines(batch), layout), batch_id, feed)

    return _started(lines, append, root, checkpoint, trigger, compact_every, clock, table)


def _started(stream: DataFrame, take: Callable, root, checkpoint, trigger, compact_every, clock, table) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        feed = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        store = ViewStore(spark, root, clock, table)
        take(store, batch, batch_id, feed)
        if compact_every is not None and (batch_id + 1) % compact_every == 0:
            store.compact()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DEFAULT_TRIGGER)).start()
