from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from retally.operators import changelog, keyed
from retally.plans import reports, views
from retally.schemas import CHANGE, EVENT
from retally.sources import changes as feeds
from retally.sources import event_text, lines
from retally.streaming.maintain import maintain, maintain_from_lines
from retally.streaming.store import ViewStore

NOW = {"availableNow": True}


@pytest.fixture
def pipeline(spark, folder):
    """A feed folder and a way to bring the views up to date with it."""

    class Pipeline:
        store = ViewStore(spark, f"{folder}/views")
        feed = f"{folder}/feed"

        def send(self, changes, fmt="parquet"):
            feeds.write_changes(changes, self.feed, fmt)

        def run(self, checkpoint="checkpoint", root="views", fmt="parquet", **source):
            stream = feeds.stream_changes(spark, self.feed, fmt, **source)
            query = maintain(stream, f"{folder}/{root}", f"{folder}/{checkpoint}", NOW)
            query.awaitTermination()
            return query

    return Pipeline()


def shown(store, name, values):
    return values(store.view(name).drop("last_updated"))


def test_snapshot_changes_restart_and_freshness(spark, seed, pipeline, values):
    store = pipeline.store
    assert store.view("quad").count() == 0
    pipeline.send(changelog.snapshot_records(seed))
    pipeline.run()
    for name, spec in views.VIEWS.items():
        assert shown(store, name, values) == values(views.full(seed, spec))
    first = {r["view"]: r for r in store.freshness().collect()}
    assert {r["last_batch"] for r in first.values()} == {0}

    pipeline.run()  # nothing new: no batch
    assert store.committed_batches() == [0]
    assert values(store.freshness(since_batch=0), "updated") == [(False,)] * 4

    gone = seed.filter("globaleventid = 3")
    pipeline.send(changelog.delete_records(gone, F.lit(10)))
    pipeline.run()
    after = seed.filter("globaleventid <> 3")
    for name, spec in views.VIEWS.items():
        assert shown(store, name, values) == values(views.full(after, spec))
    second = {r["view"]: r for r in store.freshness(since_batch=0).collect()}
    assert all(r["updated"] and r["last_updated"] > first[v]["last_updated"] for v, r in second.items())
    # only the group that changed carries the new time; the vanished one is gone
    assert store.view("quad").agg(F.max("last_updated")).head()[0] == first["quad"]["last_updated"]
    assert values(store.notices().filter("batch_id = 1"), "keys_changed") == [(1,)] * 4


def test_three_copies_raise_totals_by_three_and_leave_again(seed, pipeline, values):
    key = (F.col("event_date") == 19790101) & (F.col("quad_class") == 4)
    template = seed.filter(key).withColumns(
        {"num_events": F.lit(1), "num_articles": F.lit(1)}
    )
    copies = keyed.replicate(template, 3, *keyed.id_range(seed))
    pipeline.send(changelog.snapshot_records(seed))
    pipeline.run()
    before = pipeline.store.view("quad")
    pipeline.send(changelog.insert_records(copies))
    pipeline.run()
    after = pipeline.store.view("quad")
    diff = reports.compare_totals(before, after, *views.QUAD.keys)
    assert values(diff.filter("status <> 'same'")) == [
        (19790101, 4, 2, 5, 3, 4, 7, 3, "changed")
    ]
    pipeline.send(changelog.delete_records(copies))
    pipeline.run()
    assert shown(pipeline.store, "quad", values) == values(views.full(seed, views.QUAD))


def test_one_key_inserted_updated_and_deleted_leaves_nothing(seed, pipeline, values):
    one = seed.filter("globaleventid = 1").withColumn("event_date", F.lit(20260101))
    moved = {"goldstein": F.col("goldstein") + 1.0}
    pipeline.send(
        changelog.records(
            one,
            changelog.Change("insert", None, {}, seq=F.lit(1)),
            changelog.Change("update", {}, moved, seq=F.lit(2)),
            changelog.Change("delete", moved, None, seq=F.lit(3)),
        )
    )
    pipeline.run()
    for name in views.VIEWS:
        assert pipeline.store.view(name).count() == 0


def test_small_batches_give_the_same_views(seed, pipeline, values):
    for number in (1, 2, 3, 4):
        pipeline.send(changelog.snapshot_records(seed.filter(f"globaleventid = {number}")).coalesce(1))
    pipeline.run(max_files=1)
    assert len(pipeline.store.committed_batches()) >= 4
    assert shown(pipeline.store, "dyad", values) == values(views.full(seed, views.DYAD))


def test_json_feed(seed, pipeline, values):
    pipeline.send(changelog.snapshot_records(seed), "json")
    pipeline.run(fmt="json")
    assert shown(pipeline.store, "cameo", values) == values(views.full(seed, views.CAMEO))


def test_batch_whose_commit_was_lost_is_written_again(spark, seed, pipeline, values, folder):
    pipeline.send(changelog.snapshot_records(seed))
    pipeline.run()
    # the stream's own commit of batch 0 is lost, as if it stopped right before writing it
    commits = f"{folder}/checkpoint/commits"
    for name in os.listdir(commits):
        if name.strip(".").split(".")[0] == "0":
            os.unlink(os.path.join(commits, name))
    pipeline.run()
    assert pipeline.store.committed_batches() == [0]
    assert shown(pipeline.store, "quad", values) == values(views.full(seed, views.QUAD))


def test_half_written_batch_is_not_seen_and_is_replaced(spark, seed, folder, values):
    store = ViewStore(spark, folder)
    records = changelog.snapshot_records(seed)
    store.apply(records, 0, "f")
    # batch 1 got as far as its log, but has no notice
    views.delta(views.signed(records)).withColumn(
        "committed_at", F.current_timestamp()
    ).write.partitionBy("view").parquet(f"{folder}/log/batch_id=1")
    assert shown(store, "quad", values) == values(views.full(seed, views.QUAD))
    store.apply(changelog.delete_records(seed.filter("globaleventid = 4")), 1, "f")
    assert shown(store, "quad", values) == values(
        views.full(seed.filter("globaleventid <> 4"), views.QUAD)
    )
    # the same for a base without its mark
    store.view("quad").limit(0).write.parquet(f"{folder}/base/version=9")
    assert store.compacted_upto() == -1


def test_another_checkpoint_needs_another_root(seed, pipeline):
    pipeline.send(changelog.snapshot_records(seed))
    pipeline.run()
    with pytest.raises(Exception, match="a new checkpoint needs a new root"):
        pipeline.run(checkpoint="other")
    pipeline.run(checkpoint="third", root="views3")


def test_reader_keeps_its_state_while_batches_arrive(spark, seed, folder, values):
    store = ViewStore(spark, folder)
    store.apply(changelog.snapshot_records(seed), 0)
    old = store.view("quad")
    store.apply(changelog.delete_records(seed), 1)
    assert old.count() == 3
    assert store.view("quad").count() == 0
    store.compact()
    assert old.count() == 3
    assert store.view("quad").count() == 0
    store.apply(changelog.insert_records(seed), 2)
    assert values(store.view("quad").drop("last_updated")) == values(views.full(seed, views.QUAD))


def test_sql_over_the_stored_views(spark, seed, folder, values):
    store = ViewStore(spark, folder)
    store.apply(changelog.snapshot_records(seed), 0)
    store.register()
    found = spark.sql(
        "SELECT source_actor, sum(total_events) AS n FROM top_actors"
        " WHERE event_date BETWEEN :s AND :e GROUP BY source_actor",
        args={"s": 19790101, "e": 19791231},
    )
    assert values(found) == [("AFR", 3), ("ARG", 2), ("CHN", 1)]
    latest = spark.sql("SELECT max(last_updated) FROM daily_cameo_metrics").head()[0]
    assert abs(datetime.datetime.now() - latest) < datetime.timedelta(days=2)


def test_text_files_feed_the_views(spark, folder, values):
    os.makedirs(f"{folder}/in")
    header = "\t".join(f"h{i}" for i in range(17))

    def arrive(name, *sources):
        rows = [f"20200101\t{s}\tFRA\t043\t1\t4\t2\t1.5" + "\t" * 9 for s in sources]
        with open(f"{folder}/in/{name}", "w") as out:
            out.write("\n".join([header, *rows, "dropped"]) + "\n")

    def run():
        arriving = lines.stream_lines(spark, f"{folder}/in", max_files=1)
        maintain_from_lines(arriving, f"{folder}/views", f"{folder}/cp", NOW).awaitTermination()

    store = ViewStore(spark, f"{folder}/views")
    arrive("a.txt", "USA", "CHN")
    run()
    assert shown(store, "actor", values) == [
        (20200101, "CHN", 1, 4, 1.5),
        (20200101, "USA", 1, 4, 1.5),
    ]
    arrive("b.txt", "USA")
    run()
    assert shown(store, "actor", values)[1] == (20200101, "USA", 2, 8, 1.5)


def test_messages_decode_to_change_records(spark, seed, values):
    event = (
        '{"globaleventid":7,"event_date":20200101,"source_actor":"A","target_actor":"B",'
        '"cameo_code":"043","num_events":1,"num_articles":2,"quad_class":1,"goldstein":1.5}'
    )
    later = event.replace("1.5", "-2.5")
    rows = [
        (f'{{"seq":1,"op":"c","before":null,"after":{event}}}',),
        (f'{{"seq":2,"op":"update","before":{event},"after":{later}}}',),
    ]
    messages = spark.createDataFrame(rows, "value string").select(F.col("value").cast("binary"))
    empty = spark.createDataFrame([(None,), (b"",)], "value binary")
    changes = feeds.decode(messages.union(empty))
    assert values(changes, "seq", "op") == [(1, "insert"), (2, "update")]
    assert values(views.from_signed(views.signed(changes), views.QUAD)) == [(20200101, 1, 1, 2, -2.5)]
    with pytest.raises(Exception, match="(?i)malformed"):
        feeds.decode(spark.createDataFrame([("{oops",)], "value string")).collect()


def test_batches_must_follow_each_other(seed, spark, folder):
    store = ViewStore(spark, folder)
    records = changelog.snapshot_records(seed)
    with pytest.raises(ValueError, match="follows a batch that is not in"):
        store.apply(records, 1)
    store.apply(records, 0)
    with pytest.raises(ValueError, match="follows a batch that is not in"):
        store.apply(records, 2)


def test_many_notice_folders(seed, spark, folder, values, monkeypatch):
    monkeypatch.setattr("retally.streaming.store.GROUP", 2)
    store = ViewStore(spark, folder)
    rows = [seed.filter(F.col("globaleventid") == i + 1) for i in range(4)]
    for number in range(3):
        store.apply(changelog.insert_records(rows[number]), number)
    assert store.committed_batches() == [0, 1, 2] and store.committed_batches(1) == [2]
    fresh = values(store.freshness(1))
    assert store.compact() == 2
    assert values(store.freshness(1)) == fresh
    store.apply(changelog.insert_records(rows[3]), 3)
    assert store.committed_batches(2) == [3]
    assert values(store.freshness(2), "last_batch", "updated") == [(3, True)] * 4
    assert values(store.view("quad").drop("last_updated")) == values(views.full(seed, views.QUAD))


def test_groups_merged_already_are_read_without_a_shuffle(seed, spark, folder, values):
    def shuffles(name):
        return "Exchange" in store.view(name)._jdf.queryExecution().executedPlan().toString()

    store = ViewStore(spark, folder)
    nothing = changelog.records(
        seed.filter("globaleventid = 1").withColumn("event_date", F.lit(20260101)),
        changelog.Change("insert", None, {}),
        changelog.Change("delete", {}, None),
    )
    store.apply(changelog.snapshot_records(seed).unionByName(nothing), 0)
    assert not shuffles("dyad")
    assert values(store.view("dyad").drop("last_updated")) == values(views.full(seed, views.DYAD))
    store.apply(changelog.delete_records(seed.filter("globaleventid = 1")), 1)
    assert shuffles("dyad")
    before = values(store.view("dyad"))
    store.compact()
    assert not shuffles("dyad")
    assert values(store.view("dyad")) == before


def test_marks_without_any_changed_group(seed, spark, folder):
    store = ViewStore(spark, folder)
    store.apply(changelog.snapshot_records(seed.limit(0)), 0)
    assert store.freshness().count() == 0
    assert store.compact() == 0
    assert store.compacted_upto() == -1 or store.view("quad").count() == 0


def test_stream_compacts_as_it_goes(spark, seed, pipeline, values, folder):
    for number in (1, 2, 3, 4):
        pipeline.send(changelog.snapshot_records(seed.filter(f"globaleventid = {number}")).coalesce(1))
        stream = feeds.stream_changes(spark, pipeline.feed)
        maintain(stream, f"{folder}/views", f"{folder}/cp", NOW, compact_every=2).awaitTermination()
    assert pipeline.store.compacted_upto() == 3
    assert pipeline.store.committed_batches() == [0, 1, 2, 3]
    assert shown(pipeline.store, "actor", values) == values(views.full(seed, views.ACTOR))


def test_dashboard_from_the_store(spark, seed, folder):
    store = ViewStore(spark, folder)
    store.apply(changelog.snapshot_records(seed), 0)
    page = reports.dashboard(store.views(), 19790101, 19791231, n=10)
    assert {name: df.count() for name, df in page.items()} == {
        "kpis": 1,
        "trend": 1,
        "actors": 3,
        "dyads": 3,
        "cameo": 4,
        "quad_dist": 3,
        "quad_time": 3,
        "heatmap": 3,
    }
    assert tuple(page["kpis"].head())[:2] == (6, 2)


def test_views_are_written_without_tiny_files(spark, pipeline, folder, values):
    """A small view gets one file; a large one is split by size, also when it is hot."""
    pairs = spark.range(40_000).select(
        F.col("id").alias("globaleventid"),
        F.lit(20200101).alias("event_date"),
        F.lit("USA").alias("source_actor"),
        F.sha2(F.col("id").cast("string"), 256).alias("target_actor"),
        F.lit("010").alias("cameo_code"),
        F.lit(1).alias("num_events"),
        F.lit(1).alias("num_articles"),
        F.lit(1).alias("quad_class"),
        F.lit(1.0).alias("goldstein"),
    )
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        pipeline.send(changelog.snapshot_records(pairs))
        pipeline.run()
        ViewStore(spark, f"{folder}/views2").add(views.entering(pairs), 0)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

    for root in ("views", "views2"):
        files = [n for n in os.listdir(f"{folder}/{root}/log/batch_id=0") if n.endswith(".parquet")]
        assert 1 < len(files) <= 8  # as many as the aggregate's shuffle has parts, by size
    assert pipeline.store.view("dyad").count() == 40_000
    assert values(pipeline.store.view("quad"), "total_events", "avg_goldstein") == [(40_000, 1.0)]


def filled(spark, root, seed, batches=3, **kept):
    store = ViewStore(spark, root, **kept)
    for batch_id in range(batches):
        store.apply(changelog.insert_records(keyed.shift_ids(seed, 100 * batch_id)), batch_id)
    return store


@pytest.mark.parametrize("lost", ["commits/group=0/1.json", "commits/group=0/2.json", "commits/group=0"])
def test_a_lost_commit_record_is_an_error(spark, folder, seed, lost):
    """A view never shows fewer events because a commit record is gone, the last one neither."""
    filled(spark, f"{folder}/views", seed)
    os.rename(f"{folder}/views/{lost}", f"{folder}/lost")
    store = ViewStore(spark, f"{folder}/views")
    with pytest.raises(ValueError, match="commit records are missing"):
        store.view("quad")
    if not os.path.exists(f"{folder}/views/commits/group=0/2.json"):  # it would count twice
        with pytest.raises(ValueError, match="commit records are missing|follows a batch"):
            store.apply(changelog.insert_records(seed), 2)


def test_a_lost_file_of_a_batch_is_an_error(spark, folder, seed):
    store = filled(spark, f"{folder}/views", seed)
    log = f"{folder}/views/log/batch_id=1"
    for name in os.listdir(log):
        if name.endswith(".parquet"):
            os.rename(f"{log}/{name}", f"{folder}/{name}")
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist"):
        store.view("quad").collect()


def test_a_writer_that_stops_between_record_and_head(spark, folder, seed, values):
    filled(spark, f"{folder}/views", seed, batches=2)
    os.rename(f"{folder}/views/heads/1.json", f"{folder}/head")
    store = ViewStore(spark, f"{folder}/views")
    assert store.committed_batches() == [0, 1]  # the record is what counts
    assert not store.apply(changelog.insert_records(seed), 1)
    assert "1.json" in os.listdir(f"{folder}/views/heads")


def test_deltas_are_written_in_one_shuffle(spark, seed, folder):
    store = ViewStore(spark, folder)
    written = store._deltas(views.entering(seed), datetime.datetime.now(datetime.timezone.utc)).sortWithinPartitions("view", "event_date")
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def dated(events, *dates):
    return events(*[(i, date, "USA", "CHN", "010", 1, 1, 1, 0.5) for i, date in enumerate(dates, start=1)])


def test_folding_rewrites_touched_months_only(spark, events, folder, values):
    store = ViewStore(spark, folder)
    all_rows = dated(events, 20200101, 20200201, 20200301, 20200302)
    store.apply(changelog.snapshot_records(all_rows), 0)
    assert store.compact() == 0
    first = store._manifest()["months"]
    assert sorted(first) == ["202001", "202002", "202003"]
    gone = all_rows.filter("event_date = 20200201")
    late = dated(events, 20200331).withColumn("globaleventid", F.lit(9).cast("long"))
    store.apply(changelog.delete_records(gone).unionByName(changelog.insert_records(late)), 1)

    plan = store.view("dyad", dates=(20200101, 20200131))._jdf.queryExecution().executedPlan().toString()
    assert "month=202001" in plan and "month=202003" not in plan
    whole = store.view("dyad")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    untouched, touched = plan.split("Union")[1].split("HashAggregate")[0], plan.split("HashAggregate", 1)[1]
    assert "month=202001" in untouched and "Exchange" not in untouched
    assert "month=202001" not in touched and "month=202003" in touched
    final = all_rows.filter("event_date <> 20200201").unionByName(late)
    assert values(whole.drop("last_updated")) == values(views.full(final, views.DYAD))

    assert store.compact() == 1
    second = store._manifest()["months"]
    assert second["202001"] == first["202001"] and sorted(second) == ["202001", "202003"]
    assert all("version=1" in f for files in second["202003"].values() for f in files)
    for name, spec in views.VIEWS.items():
        assert shown(store, name, values) == values(views.full(final, spec))


def test_vacuum_removes_what_no_recent_manifest_names(spark, events, folder, values):
    now = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    hour = datetime.timedelta(hours=1)
    store = ViewStore(spark, folder, clock=lambda batch_id: now + hour * batch_id, table=True)
    for batch_id, date in enumerate((20200101, 20200201, 20200102, 20200301)):
        row = dated(events, date).withColumn("globaleventid", F.lit(batch_id + 1).cast("long"))
        store.apply(changelog.insert_records(row), batch_id)
        store.compact()
    want = {name: values(store.view(name)) for name in views.VIEWS}, values(store.events())
    assert store.vacuum(hour * 9) == []
    gone = store.vacuum(hour)  # readers may have begun with the manifest of batch 2
    assert {"manifests/0.json", "manifests/1.json", "log/batch_id=2", "base/version=0/month=202001", "commits/group=0/1.json"} <= set(gone)
    assert not {"log/batch_id=3", "base/version=1/month=202002", "base/version=2/month=202001"} & set(gone)
    again = ViewStore(spark, folder, clock=store.clock, table=True)
    assert ({name: values(again.view(name)) for name in views.VIEWS}, values(again.events())) == want
    row = dated(events, 20200401).withColumn("globaleventid", F.lit(5).cast("long"))
    assert again.apply(changelog.insert_records(row), 4) and not again.apply(changelog.insert_records(row), 4)
    assert again.events().count() == 5 and again.view("quad").count() == 5


def test_commit_clock(spark, seed, folder, values):
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    store = ViewStore(spark, folder, clock=lambda batch_id: start + datetime.timedelta(minutes=batch_id))
    store.apply(changelog.snapshot_records(seed), 0)
    store.apply(changelog.insert_records(keyed.shift_ids(seed.filter("globaleventid = 1"), 9)), 1)
    at = F.unix_seconds("last_updated") - int(start.timestamp())
    assert values(store.view("quad").select("quad_class", at)) == [(1, 60), (2, 0), (4, 0)]
    store.compact()
    assert values(store.view("quad").select("quad_class", at)) == [(1, 60), (2, 0), (4, 0)]
    assert values(store.freshness().select(at).distinct()) == [(60,)]
    with pytest.raises(ValueError, match="without a zone"):
        ViewStore(spark, f"{folder}/b", clock=lambda batch_id: datetime.datetime(2026, 1, 1)).apply(changelog.snapshot_records(seed), 0)


def test_table_follows_random_changes(spark, values, folder):
    """Keys that change, move, go and come again, over batches, folds and replays."""
    from test_changes_property import random_feed

    feed, final = random_feed(21, batches=4, size=15)
    store = ViewStore(spark, folder, table=True)
    for batch_id, batch in enumerate(feed):
        frame = spark.createDataFrame(batch, CHANGE)
        assert store.apply(frame, batch_id) and not store.apply(frame, batch_id)
        if batch_id == 2:
            store.compact()
    want = values(spark.createDataFrame(final, EVENT))
    assert values(store.events()) == want
    store.compact()
    assert values(store.events()) == want
    assert "Exchange" not in store.events()._jdf.queryExecution().executedPlan().toString()


def test_many_changed_keys_are_not_sent_to_all_tasks(spark, folder, values):
    """A log of many keys is shuffled with the base, whatever Spark makes of its file; a small one is not."""
    def plan():
        return store.events()._jdf.queryExecution().executedPlan().toString()

    measures = "cast(1 as int) as num_events, cast(1 as int) as num_articles, cast(1 as int) as quad_class, 0.5D as goldstein"
    dated_rows = ("id as globaleventid", "20200101 as event_date", "'USA' as source_actor", "'CHN' as target_actor", "'010' as cameo_code")
    spark.range(120_000).selectExpr(*dated_rows, *measures.split(", ")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    store = ViewStore(spark, f"{folder}/views", table=True)
    store.apply(changelog.snapshot_records(rows), 0)
    assert "Join" not in plan()  # no base yet
    store.compact()
    store.apply(changelog.delete_records(rows.filter("globaleventid % 8 <> 0")), 1)
    assert "Broadcast" not in plan() and "SortMergeJoin" in plan()
    assert values(store.events(), "globaleventid") == values(rows.filter("globaleventid % 8 = 0"), "globaleventid")
    store.compact()
    store.apply(changelog.delete_records(rows.filter("globaleventid = 8")), 2)
    assert "BroadcastHashJoin" in plan() and store.events().count() == 14_999


def test_folds_of_many_keys_keep_views_and_table(spark, values, folder, monkeypatch):
    """Base and log shuffled by key at every read and fold: pairs and table as from all changes at once."""
    from test_changes_property import random_feed

    monkeypatch.setattr("retally.streaming.store.MOST_KEYS", 0)
    feed, final = random_feed(22, batches=3, size=15)
    store = ViewStore(spark, folder, table=True)
    for batch_id, batch in enumerate(feed):
        store.apply(spark.createDataFrame(batch, CHANGE), batch_id)
        assert "Broadcast" not in store.events()._jdf.queryExecution().executedPlan().toString()
        if batch_id != 1:
            store.compact()
    rows = spark.createDataFrame(final, EVENT)
    assert values(store.events()) == values(rows)
    assert shown(store, "dyad", values) == values(views.full(rows, views.DYAD))


def test_an_update_of_the_key_takes_the_old_row_away(spark, seed, folder, values):
    store = ViewStore(spark, folder, table=True)
    store.apply(changelog.snapshot_records(seed), 0)
    moved = changelog.records(seed.filter("globaleventid = 2"), changelog.Change("update", {}, {"globaleventid": F.lit(20)}))
    store.apply(moved, 1)
    assert [r[0] for r in values(store.events())] == [1, 20, 3, 4]
    assert shown(store, "quad", values) == values(views.full(store.events(), views.QUAD))


def test_lines_get_ids_batch_by_batch(spark, folder, values):
    """Ids go on where the last batch ended, also after a crash before the commit; rejects are kept."""
    names = "value string, problem string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT if f.name != "globaleventid")

    def parsed(*texts):
        rows = [(t, "num_events" if t == "bad" else None, 20200101, t, "B", "010", 1, 1, 1, 0.5, *[None] * 9) for t in texts]
        return spark.createDataFrame(rows, names).repartition(3)

    class Stops(ViewStore):
        def _write_record(self, record):
            raise InterruptedError

    ViewStore(spark, folder, table=True).append_parsed(parsed("a", "bad", "b", "c"), 0)
    with pytest.raises(InterruptedError):
        Stops(spark, folder, table=True).append_parsed(parsed("d", "e"), 1)
    store = ViewStore(spark, folder, table=True)
    assert store.append_parsed(parsed("d", "bad", "e"), 1) and not store.append_parsed(parsed("x"), 1)
    assert store.append_parsed(parsed(), 2) and store.append_parsed(parsed("f"), 3)
    assert values(store.events(), "globaleventid", "source_actor")[3:] and [r[0] for r in values(store.events(), "globaleventid")] == [1, 2, 3, 4, 5, 6]
    found = dict(values(store.events(), "source_actor", "globaleventid"))
    assert {found["a"], found["b"], found["c"]} == {1, 2, 3} and {found["d"], found["e"]} == {4, 5} and found["f"] == 6
    assert values(store.rejects()) == [("bad", "num_events", 0), ("bad", "num_events", 1)]
    store.compact()
    assert values(store.rejects()) == [("bad", "num_events", 0), ("bad", "num_events", 1)]
    assert [store._record(n)["first_id"] for n in range(4)] == [1, 4, 6, 6]
