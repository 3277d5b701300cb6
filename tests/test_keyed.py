from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retally.fixtures import seed_events
from retally.operators import changelog, keyed
from retally.plans import views
from retally.schemas import CHANGE, KEY


def test_updates_put_nulls_in_and_leave_others(seed, spark, values):
    patch = spark.createDataFrame([(1, None, 9), (99, 1.0, 1)], "globaleventid long, goldstein double, num_events int")
    out = keyed.apply_updates(seed, patch)
    assert values(out, "globaleventid", "goldstein", "num_events") == [
        (1, None, 9),
        (2, 3.5, 2),
        (3, -5.0, 2),
        (4, 7.0, 1),
    ]
    assert out.columns == seed.columns


def test_latest_patch_wins(spark, values):
    patch = spark.createDataFrame(
        [(1, 1, 5.0), (1, 2, None), (2, 1, 7.0)], "globaleventid long, at int, goldstein double"
    )
    assert values(keyed.latest_patch(patch, "at")) == [(1, None), (2, 7.0)]


def test_deletes_and_rows_by_key(seed, spark, values):
    keys = spark.createDataFrame([(1,), (1,), (42,)], "globaleventid long")
    assert values(keyed.apply_deletes(seed, keys), "globaleventid") == [(2,), (3,), (4,)]
    assert values(keyed.rows_of(seed, keys), "globaleventid") == [(1,)]


def test_insert_ignore_keeps_stored_rows(seed, events, values):
    new = events(
        (1, 20200101, "X", "Y", "1", 1, 1, 1, 1.0),
        (5, 20200101, "X", "Y", "1", 1, 1, 1, 1.0),
        (5, 20200102, "X", "Y", "1", 1, 1, 1, 1.0),
    )
    out = keyed.insert_ignore(seed, new)
    assert values(out, "globaleventid", "event_date")[-1] == (5, 20200101)
    assert out.count() == 5
    assert values(keyed.insert_ignore(out, new)) == values(out)


def test_sample_events_are_added_once(spark, seed, values):
    samples = seed_events(spark)
    table = keyed.insert_ignore(samples.limit(0), samples)
    assert values(keyed.insert_ignore(table, samples)) == values(samples)
    assert values(samples, *seed.columns) == values(seed)
    assert values(samples, "action_geo_lat")[0] == (-34.0,)


def test_upsert_changes_only_named_columns(seed, events, values):
    rows = events(
        (1, 20200101, "X", "Y", "1", 8, 8, 8, 8.0),
        (5, 20200101, "X", "Y", "1", 9, 9, 9, None),
    )
    out = keyed.upsert(seed, rows, ["goldstein", "num_events"])
    assert values(out.filter("globaleventid in (1, 5)")) == [
        (1, 19790101, "AFR", "FRA", "043", 8, 4, 1, 8.0),
        (5, 20200101, "X", "Y", "1", 9, 9, 9, None),
    ]
    with pytest.raises(Exception, match="two rows to upsert have key [15]"):
        keyed.upsert(seed, rows.unionByName(rows), ["goldstein"]).collect()


def test_expression_update(seed, values):
    out = keyed.update_where(
        seed, F.col("globaleventid") == 3, goldstein=F.coalesce("goldstein", F.lit(0.0)) + 1.0
    )
    assert values(out, "globaleventid", "goldstein")[2] == (3, -4.0)


def test_replicas_get_free_keys(seed, values):
    low, high = keyed.id_range(seed)
    copies = keyed.replicate(seed, 3, low, high, origin="template")
    ids = [r[0] for r in values(copies, "globaleventid")]
    assert len(set(ids)) == 12 and min(ids) > high
    lists = keyed.id_list(copies, "template")
    assert values(lists)[0] == (1, "5,9,13")
    parsed = lists.select("template", keyed.parse_ids(F.col("id_list")).alias("ids"))
    assert values(parsed)[0] == (1, [5, 9, 13])
    assert values(seed.filter(F.array_contains(F.lit([1, 4]), F.col("globaleventid"))), "globaleventid") == [(1,), (4,)]


def test_id_range_of_nothing(events):
    assert keyed.id_range(events()) == (0, 0)


def test_sample_is_reproducible_and_depends_on_the_seed(spark, values):
    df = spark.range(1000).withColumnRenamed("id", "globaleventid")
    one = values(keyed.sample_keys(df, 50, "a"))
    assert one == values(keyed.sample_keys(df.repartition(7), 50, "a"))
    assert one != values(keyed.sample_keys(df, 50, "b"))
    assert keyed.sample_keys(df, 5000, "a").count() == 1000
    assert keyed.append_sample(df, 50, "a", 10_000).select("globaleventid").distinct().count() == 1050


def test_records_of_old_and_new_tables(seed, values):
    new = keyed.update_where(seed, F.col("globaleventid") < 3, num_events=F.lit(7))
    made = changelog.update_records(seed, new.filter("globaleventid < 3"))
    assert made.schema.simpleString() == CHANGE.simpleString()
    assert values(made, "seq", "op", "before.num_events", "after.num_events") == [
        (1, "update", 1, 7),
        (2, "update", 2, 7),
    ]
    assert values(changelog.apply_changes(seed, made)) == values(new)


def test_last_change_of_a_key_counts(seed, values):
    changes = changelog.records(
        seed.filter("globaleventid = 1"),
        changelog.Change("update", {}, {"num_events": F.lit(5)}, seq=F.lit(1)),
        changelog.Change("update", {"num_events": F.lit(5)}, {"num_events": F.lit(6)}, seq=F.lit(2)),
    )
    assert values(changelog.apply_changes(seed, changes), "globaleventid", "num_events")[0] == (1, 6)
    gone = changes.unionByName(
        changelog.delete_records(
            seed.filter("globaleventid = 1").withColumn("num_events", F.lit(6)), F.lit(3)
        )
    )
    assert changelog.apply_changes(seed, gone).count() == 3


def test_bad_change_records_fail(spark):
    event = (1, 20200101, "A", "B", "1", 1, 1, 1, 1.0) + (None,) * 9
    for record, message in (
        ((1, "update", None, event), "change record without before: seq 1"),
        ((2, "delete", None, None), "change record without before: seq 2"),
        ((3, "insert", event, None), "change record without after: seq 3"),
        ((4, "merge", event, event), "unknown change operation: merge"),
        ((5, None, event, event), "unknown change operation: NULL"),
    ):
        changes = spark.createDataFrame([record], CHANGE)
        with pytest.raises(Exception, match=message):
            views.delta(views.signed(changes)).collect()


def test_images_an_operation_does_not_use_are_ignored(spark, values):
    event = (1, 20200101, "A", "B", "1", 1, 1, 1, 1.0) + (None,) * 9
    changes = spark.createDataFrame([(1, "insert", event, event)], CHANGE)
    assert values(views.signed(changes), "sign") == [(1,)]


@pytest.mark.parametrize("n", [0, 1, 7, 500, 2000, 5000])
def test_sample_is_the_least_hashes_whatever_the_prefixes(spark, monkeypatch, n):
    monkeypatch.setattr(keyed, "_DIGITS", 1)
    monkeypatch.setattr(keyed, "_SORTED", 10)
    rows = spark.range(2000).withColumnRenamed("id", KEY)
    hashed = F.md5(F.concat(F.col(KEY).cast("string"), F.lit("s")))
    expected = [r[0] for r in rows.orderBy(hashed, KEY).limit(n).collect()]
    assert [r[0] for r in keyed.sample_keys(rows, n, "s").collect()] == expected


def test_only_few_rows_of_a_sample_are_sorted(spark):
    rows = spark.range(100_000).withColumnRenamed("id", KEY)
    plan = keyed.sample_keys(rows, 50, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "TakeOrdered" in plan
