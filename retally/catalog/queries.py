"""Registered queries: name -> function of (session, folder of the given tables)."""

from __future__ import annotations

import datetime
import operator
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import keyed_events, line_events, seed_events
from ..functions.dates import in_date_range, to_day, to_ymd
from ..functions.labels import percent
from ..operators import changelog, keyed
from ..plans import reports, views
from ..schemas import KEY, LINE_FIELDS
from ..session import shared_folder
from ..sources import changes as feeds
from ..sources import event_table, event_text, lines
from ..streaming.maintain import maintain, maintain_from_lines
from ..streaming.store import ViewStore
from . import scenario

START, END = 19790101, 20260131
AS_OF = "2024-02-03"
SAMPLE = 1000
SAMPLE_SHIFT = 1_000_000
COPIES = 3
SEED = "retally"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def _register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def _line_view(spark: SparkSession, folder: str, spec: views.ViewSpec) -> DataFrame:
    """A view over order lines in the reports' range; reads the tables its keys need."""
    columns = (*spec.keys, *views.MEASURED)
    return views.full(line_events(spark, folder, *columns, dates=(START, END)), spec)


def _lines(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    columns = ("event_date", *keys, "num_events", "goldstein")
    return line_events(spark, folder, *columns, dates=(START, END))


def _log_view(spark: SparkSession, folder: str, spec: views.ViewSpec) -> DataFrame:
    return views.full(keyed_events(spark, folder), spec)


# --- views and full recomputation --------------------------------------------------------


def _register_views() -> None:
    for spec in views.VIEWS.values():

        def view(spark, folder, spec=spec):
            return views.full(line_events(spark, folder, *spec.keys, *views.MEASURED), spec)

        def recompute(spark, folder, spec=spec):
            events = line_events(spark, folder, *spec.keys, *views.MEASURED)
            return views.full_filtered(events, spec)

        QUERIES[f"view_{spec.name}"] = view
        QUERIES[f"recompute_{spec.name}"] = recompute


_register_views()


# --- reports -----------------------------------------------------------------------------


@_register("date_bounds")
def date_bounds(spark, folder):
    return reports.date_bounds(_log_view(spark, folder, views.QUAD), AS_OF)


@_register("kpis")
def kpis(spark, folder):
    return reports.kpis(_line_view(spark, folder, views.QUAD), START, END)


@_register("trend")
def trend(spark, folder):
    return reports.trend(_line_view(spark, folder, views.QUAD), START, END)


@_register("top_actors_iso")
def top_actors_iso(spark, folder):
    return reports.top_actors(_log_view(spark, folder, views.ACTOR), START, END)


@_register("top_dyads")
def top_dyads(spark, folder):
    return reports.top_dyads(_line_view(spark, folder, views.DYAD), START, END)


@_register("top_cameo")
def top_cameo(spark, folder):
    codes = reports.top_cameo(_line_view(spark, folder, views.CAMEO), START, END)
    return reports.bottom_up(codes, reports.TOP_N, "cameo_code")


@_register("quad_dist")
def quad_dist(spark, folder):
    return reports.quad_dist(_line_view(spark, folder, views.QUAD), START, END)


@_register("quad_time")
def quad_time(spark, folder):
    return reports.quad_time(_line_view(spark, folder, views.QUAD), START, END)


@_register("dyad_heatmap")
def dyad_heatmap(spark, folder):
    return reports.heatmap_cells(top_dyads(spark, folder))


@_register("heatmap_grid")
def heatmap_grid(spark, folder):
    """The heatmap with its zero cells, one row per cell."""
    return reports.heatmap_grid(dyad_heatmap(spark, folder))


@_register("raw_daily")
def raw_daily(spark, folder):
    events = _lines(spark, folder, "quad_class")
    return reports.raw_daily(events, START, END)


@_register("raw_actors")
def raw_actors(spark, folder):
    return reports.raw_actors(keyed_events(spark, folder), START, END)


@_register("raw_dyads")
def raw_dyads(spark, folder):
    events = _lines(spark, folder, "source_actor", "target_actor")
    return reports.raw_dyads(events, START, END)


@_register("raw_cameo")
def raw_cameo(spark, folder):
    events = _lines(spark, folder, "cameo_code")
    return reports.raw_cameo(events, START, END)


@_register("rollup_daily")
def rollup_daily(spark, folder):
    return reports.rollup_daily(_line_view(spark, folder, views.QUAD), START, END)


@_register("rollup_actors")
def rollup_actors(spark, folder):
    return reports.rollup_actors(_log_view(spark, folder, views.ACTOR), START, END)


@_register("rollup_dyads")
def rollup_dyads(spark, folder):
    return reports.rollup_dyads(_line_view(spark, folder, views.DYAD), START, END)


@_register("rollup_cameo")
def rollup_cameo(spark, folder):
    return reports.rollup_cameo(_line_view(spark, folder, views.CAMEO), START, END)


@_register("view_counts")
def view_counts(spark, folder):
    events = keyed_events(spark, folder)
    return views.group_counts(views.delta(views.entering(events)))


@_register("sql_report")
def sql_report(spark, folder):
    """Parameterised SQL over a view: the busiest class of the latest day."""
    return spark.sql(
        """
        SELECT event_date, quad_class, total_events, total_articles, avg_goldstein
        FROM {quad}
        WHERE event_date BETWEEN :s AND :e
          AND event_date = (SELECT max(event_date) FROM {events})
          AND quad_class = :q
        """,
        args={"s": START, "e": END, "q": 1},
        quad=_log_view(spark, folder, views.QUAD),
        events=keyed_events(spark, folder),
    )


# --- changes of a keyed table ------------------------------------------------------------


@_register("update_by_key")
def update_by_key(spark, folder):
    events = keyed_events(spark, folder)
    return keyed.apply_updates(events, scenario.rescore_patch(events))


@_register("delete_by_keys")
def delete_by_keys(spark, folder):
    events = keyed_events(spark, folder)
    return keyed.apply_deletes(events, events.filter(scenario.has_code(scenario.ERROR)))


@_register("rows_by_keys")
def rows_by_keys(spark, folder):
    events = keyed_events(spark, folder)
    return keyed.rows_of(events, events.filter(scenario.has_code(scenario.ERROR)))


def _incoming(events: DataFrame) -> DataFrame:
    """Rows that partly exist: purchases with new values, and late page views."""
    low, high = keyed.id_range(events)
    known = events.filter(scenario.has_code(scenario.PURCHASE)).withColumns(scenario.rescored())
    return known.unionByName(scenario.late_rows(events, high - low + 1))


@_register("insert_ignore")
def insert_ignore(spark, folder):
    events = keyed_events(spark, folder)
    return keyed.insert_ignore(events, _incoming(events))


@_register("upsert_by_key")
def upsert_by_key(spark, folder):
    events = keyed_events(spark, folder)
    return keyed.upsert(events, _incoming(events), ["goldstein", "num_events"])


@_register("duplicate_keys")
def duplicate_keys(spark, folder):
    """Keys that a plain append of the incoming rows would store twice."""
    events = keyed_events(spark, folder)
    return keyed.duplicate_keys(events.unionByName(_incoming(events)))


@_register("expr_update")
def expr_update(spark, folder):
    events = keyed_events(spark, folder)
    purchases = scenario.has_code(scenario.PURCHASE)
    return keyed.update_where(events, purchases, **scenario.incremented())


@_register("sample_keys")
def sample_keys(spark, folder):
    return keyed.sample_keys(keyed_events(spark, folder), SAMPLE, SEED).select(KEY)


@_register("append_sample")
def append_sample(spark, folder):
    events = keyed_events(spark, folder)
    shift = keyed.id_range(events)[1] + SAMPLE_SHIFT
    return keyed.append_sample(events, SAMPLE, SEED, shift)


def _copies(events: DataFrame, origin: str | None = None) -> DataFrame:
    low, high = keyed.id_range(events)
    return keyed.replicate(events, COPIES, low, high, origin=origin)


@_register("replicate_rows")
def replicate_rows(spark, folder):
    return _copies(keyed_events(spark, folder))


@_register("id_list")
def id_list(spark, folder):
    return keyed.id_list(_copies(keyed_events(spark, folder), "template_id"), "template_id")


@_register("id_pieces")
def id_pieces(spark, folder):
    """Ids of the events of each code in pieces of a hundred; one code has most of the events."""
    return keyed.id_pieces(keyed_events(spark, folder), "cameo_code", size=100)


@_register("parse_ids")
def parse_ids(spark, folder):
    listed = id_list(spark, folder)
    return listed.select("template_id", F.explode(keyed.parse_ids(F.col("id_list"))).alias(KEY))


@_register("scalar_fns")
def scalar_fns(spark, folder):
    events = keyed_events(spark, folder)
    source, day = F.col("source_actor"), to_day(F.col("event_date"))
    return events.select(
        KEY,
        day.alias("event_day"),
        to_ymd(F.date_add(day, 7)).alias("week_later"),
        F.col("event_date").cast("string").alias("date_text"),
        F.col("num_events").cast("bigint").alias("num_events_long"),
        F.char_length(source).alias("source_length"),
        F.coalesce(F.col("goldstein"), F.lit(0.0)).alias("score_or_zero"),
        F.greatest(F.col("goldstein"), F.lit(0.0)).alias("score_at_least_zero"),
        F.concat(source, F.lit(","), F.col("target_actor")).alias("pair"),
        percent(F.col("num_events"), F.col("num_articles") - F.lit(1)).alias("share"),
        (F.col(KEY) + F.lit(SAMPLE_SHIFT)).alias("shifted_id"),
    )


# --- change records and views ------------------------------------------------------------


def _changed_view(events: DataFrame, records: DataFrame, spec: views.ViewSpec) -> DataFrame:
    """A view after changes, from the rows of the table and the signed rows of the records."""
    signed = views.entering(events).unionByName(views.signed(records))
    return views.from_signed(signed, spec)


def _register_changes() -> None:
    for spec in views.VIEWS.values():

        def after_all(spark, folder, spec=spec):
            events = keyed_events(spark, folder)
            return _changed_view(events, scenario.all_changes(events), spec)

        QUERIES[f"changelog_delta_{spec.name}"] = after_all
    for name, part, spec in (
        ("value_update", "rescore", views.QUAD),
        ("group_move", "move", views.DYAD),
        ("null_scores", "unscore", views.CAMEO),
        ("vanishing_group", "delete", views.CAMEO),
        ("late_inserts", "late", views.ACTOR),
        ("net_nothing", "transient", views.QUAD),
    ):

        def after_part(spark, folder, part=part, spec=spec):
            events = keyed_events(spark, folder)
            return _changed_view(events, scenario.some_changes(events, part), spec)

        QUERIES[name] = after_part


_register_changes()


@_register("exact_scores")
def exact_scores(spark, folder):
    """Means of scores of many digits and very different sizes, after half of them were retracted."""
    events = scenario.many_digits(keyed_events(spark, folder))
    signed = views.entering(events).unionByName(views.signed(scenario.odd_deletes(events)))
    return views.from_signed(signed, views.QUAD)


@_register("changed_table")
def changed_table(spark, folder):
    events = keyed_events(spark, folder)
    return changelog.apply_changes(events, scenario.all_changes(events))


@_register("snapshot_diff")
def snapshot_diff(spark, folder):
    events = keyed_events(spark, folder)
    before = views.full(events, views.CAMEO)
    after = _changed_view(events, scenario.all_changes(events), views.CAMEO)
    return reports.compare_totals(before, after, *views.CAMEO.keys)


@_register("reconcile_key")
def reconcile_key(spark, folder):
    """Per day and class: three copies of its first event, counting 1 and 1 each, must raise
    the totals by exactly 3 and 3."""
    events = keyed_events(spark, folder)
    keys = views.QUAD.keys
    low, high = keyed.id_range(events)
    others = [c for c in events.columns if c not in (*keys, KEY)]
    first = events.groupBy(*keys).agg(F.min(F.struct(KEY, *others)).alias("t"))
    template = first.select(*keys, "t.*").select(*events.columns)
    one = F.lit(1).cast("int")
    counted_once = template.withColumns({"num_events": one, "num_articles": one})
    copies = keyed.replicate(counted_once, COPIES, low, high)
    before = views.full(events, views.QUAD)
    after = _changed_view(events, changelog.insert_records(copies), views.QUAD)
    return reports.compare_totals(before, after, *keys).drop("status")


# --- text files --------------------------------------------------------------------------

_FULL_HEADER = "\t".join(name for name, _, _ in LINE_FIELDS)


def _work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


_made: dict[tuple, str] = {}


def _once(spark: SparkSession, folder: str, kind: str, make: Callable[[str], None]) -> str:
    """A folder written by ``make``, once per session, input and kind."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _made:
        path = f"{_work_folder(spark)}/{kind}"
        make(path)
        _made[key] = path
    return _made[key]


def text_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log with positions, as it is put into text files."""
    place = F.col("num_articles")
    return keyed_events(spark, folder).withColumns(
        {
            "source_geo_type": F.lit(1),
            "source_geo_lat": place * F.lit(1.5),
            "source_geo_long": place * F.lit(-2.25),
            "target_geo_type": F.lit(4),
            "target_geo_lat": F.col("num_events") * F.lit(0.5),
            "target_geo_long": F.lit(None).cast("double"),
            "action_geo_type": F.col("quad_class"),
            "action_geo_lat": place + F.lit(0.25),
            "action_geo_long": F.lit(-3.0),
        }
    )


def _write_text(
    spark: SparkSession,
    folder: str,
    path: str,
    mostly_short: bool,
    rare_first: bool = False,
    odd_headers: bool = False,
    bad_fields: bool = False,
) -> None:
    """The event log as messy text: a header per file, lines of both layouts (clicks in the
    rarer one), stray NUL and CR characters, and error events as lines of a wrong size.

    ``rare_first`` puts the lines of the rarer layout before all others. With ``odd_headers``
    the first line of a file is its first data line once more, or differs from file to file.
    With ``bad_fields`` error events have lines of the right size whose count is a word, in several files.
    """
    events = text_events(spark, folder)
    names = [name for name, _, _ in LINE_FIELDS]
    texts = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names}
    full = F.concat_ws("\t", *texts.values())
    short = F.concat_ws("\t", *[texts[n] for n in names[:8] + names[14:]])
    wrong = F.concat_ws("\t", *[texts[n] for n in names[:12]])
    if bad_fields:
        wrong = F.concat_ws("\t", *[F.lit("many") if n == "num_events" else texts[n] for n in names])
    click, error = scenario.has_code(scenario.CLICK), scenario.has_code(scenario.ERROR)
    line = F.when(error, wrong).when(click != F.lit(mostly_short), short).otherwise(full)
    stray = F.when(scenario.has_code(scenario.SIGNUP), F.concat(F.lit("\0"), line, F.lit("\r")))
    lines_ = events.select(F.coalesce(stray, line).alias("line"), (~click).alias("common"))
    if rare_first:
        lines_ = lines_.where("common IS NOT TRUE").unionByName(lines_.where("common"))
    elif odd_headers or bad_fields:
        lines_ = lines_.repartition(4, "line")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    body = lines_.select("line", place.alias("place"), F.spark_partition_id().alias("part"))
    header = F.lit(_FULL_HEADER)
    if odd_headers:
        header = F.when(F.col("part") % 2 == 0, F.col("line")).otherwise(F.concat(F.lit("file "), F.col("part")))
    headed = F.when(F.col("place") == 0, F.array(header, "line"))
    body.select(F.explode(F.coalesce(headed, F.array("line"))).alias("value")).write.text(path)


def _text_folder(spark, folder, mostly_short=False) -> str:
    kind = "short" if mostly_short else "full"
    return _once(spark, folder, kind, lambda path: _write_text(spark, folder, path, mostly_short))


@_register("load_text")
def load_text(spark, folder):
    return event_text.read_events(spark, _text_folder(spark, folder), gapless_ids=False).drop(KEY)


@_register("load_text_short")
def load_text_short(spark, folder):
    path = _text_folder(spark, folder, mostly_short=True)
    return event_text.read_events(spark, path, gapless_ids=False).drop(KEY)


@_register("load_text_late_layout")
def load_text_late_layout(spark, folder):
    """All lines of the rarer layout come first; the positions of the others are kept."""
    path = _once(spark, folder, "late", lambda path: _write_text(spark, folder, path, False, rare_first=True))
    return event_text.read_events(spark, path, gapless_ids=False).drop(KEY)


@_register("load_text_repeats")
def load_text_repeats(spark, folder):
    """First lines that equal data lines, or differ from file to file, are the only ones left out."""
    path = _once(spark, folder, "repeats", lambda path: _write_text(spark, folder, path, False, odd_headers=True))
    return event_text.read_events(spark, path, gapless_ids=False).drop(KEY)


@_register("load_slices")
def load_slices(spark, folder):
    """The same file in two consecutive batches of lines."""
    path = _text_folder(spark, folder)
    half = lines.read_lines(spark, path).count() // 2
    first = event_text.read_events(spark, path, offset=0, limit=half, gapless_ids=False)
    rest = event_text.read_events(spark, path, offset=half, gapless_ids=False)
    return first.unionByName(rest).drop(KEY)


@_register("load_ids")
def load_ids(spark, folder):
    """Ids given to loaded rows follow the largest existing one without gaps."""
    last = event_text.max_id(keyed_events(spark, folder))
    loaded = event_text.read_events(spark, _text_folder(spark, folder), after_id=last)
    return loaded.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(KEY).alias("first_id"),
        F.max(KEY).alias("last_id"),
        F.sum(KEY).cast("bigint").alias("sum_ids"),
    )


@_register("line_report")
def line_report(spark, folder):
    path = _text_folder(spark, folder)
    return event_text.line_report(lines.read_lines(spark, path))


@_register("stored_table")
def stored_table(spark, folder):
    """The event table written anew, added to, and read back for the reports' range."""

    def make(path: str) -> None:
        events = text_events(spark, folder)
        low, high = keyed.id_range(events)
        event_table.write_events(events, path, "overwrite")
        event_table.write_events(scenario.late_rows(events, high - low + 1), path, "append")

    path = _once(spark, folder, "events", make)
    stored = in_date_range(event_table.read_events_table(spark, path), START, END)
    return stored.drop("event_month")


def _text_store(spark: SparkSession, folder: str, bad_fields: bool = False) -> ViewStore:
    """A store kept from a stream of text files, a file or more a batch."""
    kind = "bad" if bad_fields else "full"
    path = _once(spark, folder, kind, lambda path: _write_text(spark, folder, path, False, bad_fields=bad_fields))

    def make(root: str) -> None:
        arriving = lines.stream_lines(spark, path, max_files=2)
        maintain_from_lines(arriving, root, f"{root}-checkpoint", {"availableNow": True}, table=True).awaitTermination()

    return ViewStore(spark, _once(spark, folder, f"{kind}-text-views", make), table=True)


@_register("stream_text")
def stream_text(spark, folder):
    """Text files taken in as a stream that keeps the views; the class view."""
    return _text_store(spark, folder).view("quad").drop("last_updated")


@_register("stream_ids")
def stream_ids(spark, folder):
    """Ids that a stream of text files gives: they follow each other from batch to batch."""
    return _text_store(spark, folder).events().agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(KEY).alias("n_ids"),
        F.min(KEY).alias("first_id"),
        F.max(KEY).alias("last_id"),
        F.sum(KEY).cast("bigint").alias("sum_ids"),
    )


@_register("stream_rejects")
def stream_rejects(spark, folder):
    """Events and rejected lines of the same stream, by class and by bad field."""
    store = _text_store(spark, folder, bad_fields=True)
    good = store.events().groupBy(F.col("quad_class").cast("string").alias("kind"))
    bad = store.rejects().groupBy(F.concat(F.lit("bad "), "problem").alias("kind"))
    n = F.count(F.lit(1)).alias("n_lines")
    return good.agg(n).unionByName(bad.agg(n))


# --- change stream -----------------------------------------------------------------------

#: Time of the first batch of the stores below; one hour more for each batch.
FIRST_COMMIT = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def commit_time(batch_id: int) -> datetime.datetime:
    return FIRST_COMMIT + datetime.timedelta(hours=batch_id)


def _stream(spark: SparkSession, folder: str, root: str) -> None:
    """Views and their table from the streaming query: a snapshot first, then, after a restart
    from the checkpoint, one round of changes."""
    events = keyed_events(spark, folder)
    feed = f"{root}-feed"
    for records in (changelog.snapshot_records(events), scenario.all_changes(events)):
        feeds.write_changes(records, feed)
        changes, now = feeds.stream_changes(spark, feed), {"availableNow": True}
        maintain(changes, root, f"{root}-checkpoint", now, clock=commit_time, table=True).awaitTermination()


def _stream_store(spark: SparkSession, folder: str) -> ViewStore:
    return ViewStore(spark, _once(spark, folder, "views", lambda root: _stream(spark, folder, root)), table=True)


def _with_seconds(view: DataFrame) -> DataFrame:
    """A view with the time of its groups' last change in seconds, whatever the session's zone."""
    return view.withColumn("last_updated", F.unix_seconds("last_updated")).withColumnRenamed("last_updated", "updated_at_s")


def _register_stream() -> None:
    for name in views.VIEWS:

        def maintained(spark, folder, name=name):
            return _with_seconds(_stream_store(spark, folder).view(name))

        QUERIES[f"stream_view_{name}"] = maintained


_register_stream()


@_register("stream_notices")
def stream_notices(spark, folder):
    return _stream_store(spark, folder).notices().select("batch_id", "view", "keys_changed")


@_register("stream_freshness")
def stream_freshness(spark, folder):
    fresh = _stream_store(spark, folder).freshness(since_batch=0)
    return fresh.select("view", "last_batch", "updated", F.unix_seconds("last_updated").alias("updated_at_s"))


@_register("stream_kpis")
def stream_kpis(spark, folder):
    return reports.kpis(_stream_store(spark, folder).view("quad"), START, END)


@_register("stream_top_dyads")
def stream_top_dyads(spark, folder):
    return reports.top_dyads(_stream_store(spark, folder).view("dyad"), START, END)


@_register("stream_table")
def stream_table(spark, folder):
    """The table that the change stream leaves."""
    return _stream_store(spark, folder).events().select(*keyed_events(spark, folder).columns)


def _matches(store: ViewStore) -> DataFrame:
    """Per view: its groups, and those that recomputation over the stored table gives alike."""
    events, found = store.events(), []
    for name, spec in views.VIEWS.items():
        same = reduce(operator.and_, [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in spec.keys])
        v, r = store.view(name).drop("last_updated"), views.full(events, spec)
        measures = [c for c in v.columns if c not in spec.keys]
        alike = reduce(operator.and_, [F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}")) for c in measures])
        both = v.withColumn("v_there", F.lit(1)).alias("v").join(r.withColumn("r_there", F.lit(1)).alias("r"), same, "full")
        there = F.col("v_there").isNotNull() & F.col("r_there").isNotNull()
        found.append(both.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n_groups"), F.count_if(there & alike).alias("n_alike")))
    return reduce(DataFrame.unionByName, found)


@_register("stream_table_views")
def stream_table_views(spark, folder):
    """Recomputation over the stored table against the views kept by the same stream."""
    return _matches(_stream_store(spark, folder))


def _folded_store(spark: SparkSession, folder: str) -> ViewStore:
    """A store of its own whose log is folded after every batch."""

    def make(root: str) -> None:
        store, events = ViewStore(spark, root, commit_time, table=True), keyed_events(spark, folder)
        for batch_id, records in enumerate((changelog.snapshot_records(events), scenario.all_changes(events))):
            store.apply(records, batch_id)
            store.compact()

    return ViewStore(spark, _once(spark, folder, "folded", make), commit_time, table=True)


@_register("compacted_dyad")
def compacted_dyad(spark, folder):
    """The pair view after its log was folded into a new base twice."""
    return _folded_store(spark, folder).view("dyad").drop("last_updated")


@_register("compacted_table")
def compacted_table(spark, folder):
    """The table after its log was folded, bucket by bucket."""
    return _folded_store(spark, folder).events().select(*keyed_events(spark, folder).columns)


@_register("compacted_cameo_range")
def compacted_cameo_range(spark, folder):
    """The code view of some months of the folded store: files of other months are not read."""
    dates = (20240101, 20240131)
    return _folded_store(spark, folder).view("cameo", dates=dates).drop("last_updated")


class _Stopping(ViewStore):
    """A store whose writer stops once, after a batch is written and before it is committed."""

    stops_at: int | None = None

    def _write_record(self, record: dict) -> bool:
        if record["batch_id"] == self.stops_at:
            self.stops_at = None
            raise InterruptedError("stopped before the commit record")
        return super()._write_record(record)


def _crashed_store(spark: SparkSession, folder: str) -> ViewStore:
    """A store whose writer stops between log and commit record of batch 1, comes back and replays
    it, and gets every batch once more afterwards."""

    def make(root: str) -> None:
        events = keyed_events(spark, folder)
        batches = [changelog.snapshot_records(events), scenario.all_changes(events)]
        store = _Stopping(spark, root, commit_time, table=True)
        store.stops_at = 1
        store.apply(batches[0], 0, "feed")
        try:
            store.apply(batches[1], 1, "feed")
        except InterruptedError:
            half = ViewStore(spark, root, commit_time, table=True)
            if half.committed_batches() != [0]:
                raise ValueError("a batch without a commit record is seen") from None
        for batch_id, records in [(1, batches[1]), (0, batches[0]), (1, batches[1])]:
            ViewStore(spark, root, commit_time, table=True).apply(records, batch_id, "feed")

    return ViewStore(spark, _once(spark, folder, "crashed", make), table=True)


@_register("crash_replay_views")
def crash_replay_views(spark, folder):
    """Views and table after a crash, a replay and duplicate deliveries: all groups once."""
    return _matches(_crashed_store(spark, folder))


@_register("crash_replay_dyad")
def crash_replay_dyad(spark, folder):
    return _with_seconds(_crashed_store(spark, folder).view("dyad"))


@_register("stream_append")
def stream_append(spark, folder):
    """What a batch of sampled events under new keys adds to the class view of a store."""
    events = keyed_events(spark, folder)

    def make(root: str) -> None:
        store = ViewStore(spark, root, commit_time)
        store.apply(changelog.snapshot_records(events), 0)
        new = keyed.shift_ids(keyed.sample_keys(events, SAMPLE, SEED), keyed.id_range(events)[1] + SAMPLE_SHIFT)
        store.apply(changelog.insert_records(new), 1)

    store = ViewStore(spark, _once(spark, folder, "appended", make))
    before = views.full(events, views.QUAD)
    return reports.compare_totals(before, store.view("quad").drop("last_updated"), *views.QUAD.keys)


@_register("stream_sql")
def stream_sql(spark, folder):
    """SQL over the stored views under their table names: days by events, with their busiest code."""
    _stream_store(spark, folder).register()
    return spark.sql(
        """
        SELECT d.event_date, d.total_events, c.cameo_code
        FROM (SELECT event_date, CAST(sum(total_events) AS BIGINT) AS total_events
              FROM daily_event_volume_by_quadclass WHERE event_date BETWEEN :s AND :e GROUP BY event_date) d
        JOIN (SELECT event_date, max_by(cameo_code, struct(total_events, cameo_code)) AS cameo_code
              FROM daily_cameo_metrics GROUP BY event_date) c ON c.event_date = d.event_date
        """,
        args={"s": START, "e": END},
    )


@_register("seeded_table")
def seeded_table(spark, folder):
    """The event log with the sample events that a new table starts with, where their keys are free."""
    events = keyed_events(spark, folder).filter(F.col(KEY) > 2)
    return keyed.insert_ignore(events, seed_events(spark).select(*events.columns))
