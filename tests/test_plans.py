"""What the plans look like: pushed filters, pruned columns, partial sums, no Python, no cross joins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from retally.catalog.queries import QUERIES
from retally.operators import changelog
from retally.plans import reports, views
from retally.sources import changes as feeds
from retally.streaming.store import ViewStore

FOLDER = "/root/testdata/sf0.001"
STREAMED = {name for name in QUERIES if name.startswith(("stream_", "compacted_", "crash_"))}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_python_and_no_products(spark, name):
    plan = physical(entry.queries()[name](spark, FOLDER))
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Arrow"):
        assert unwanted not in plan
    assert "FileScan" in plan


def test_reports_on_the_class_view_read_lines_only(spark):
    plan = physical(entry.queries()["kpis"](spark, FOLDER))
    assert plan.count("FileScan") == 1 and "lineitem" in plan
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "l_extendedprice" not in schema


def test_top_reports_do_not_sort_everything(spark):
    for name in ("top_actors_iso", "top_dyads", "raw_cameo", "sample_keys"):
        assert "TakeOrderedAndProject" in physical(entry.queries()[name](spark, FOLDER))


def test_heatmap_reads_its_list_once(spark):
    plan = physical(entry.queries()["dyad_heatmap"](spark, FOLDER))
    assert plan.count("lineitem.parquet") == 1


def test_all_deltas_in_one_shuffle_with_partial_sums(spark, seed, folder):
    feeds.write_changes(changelog.snapshot_records(seed), folder)
    plan = physical(views.delta(views.signed(feeds.read_changes(spark, folder))))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan.split("Exchange")[1]
    assert "geo" not in plan.split("ReadSchema:")[1]


def test_all_changes_in_one_scan(spark):
    plan = physical(entry.queries()["changelog_delta_quad"](spark, FOLDER))
    assert plan.count("FileScan") == 2  # the table, and the changes made from it


def test_date_range_reaches_the_stored_views(spark, seed, folder):
    store = ViewStore(spark, folder)
    store.apply(changelog.snapshot_records(seed), 0)
    store.compact()
    store.apply(changelog.delete_records(seed.filter(F.col("globaleventid") == 1)), 1)
    plan = physical(reports.kpis(store.view("quad"), 19790101, 19791231))
    assert plan.count("FileScan") == 2  # base and log of the one month
    assert "EqualTo(view,quad)" in plan
    for scan in plan.split("FileScan")[1:]:
        assert "view=dyad" not in scan
        assert "GreaterThanOrEqual(event_date,19790101)" in scan
        assert "source_actor" not in scan.split("ReadSchema:")[1].split("\n")[0]
