from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from retally.functions import dates, labels
from retally.plans import reports, views
from retally.sources.event_table import read_events_table, write_events

DAY = datetime.date


@pytest.fixture
def quad(spark):
    return spark.createDataFrame(
        [
            (20200101, 1, 10, 20, 1.0),
            (20200101, 3, 30, 40, -2.0),
            (20200102, 4, 20, 10, None),
            (20200103, 9, 40, 10, 4.0),
        ],
        "event_date int, quad_class int, total_events long, total_articles long,"
        " avg_goldstein double",
    )


def test_kpis(quad, values):
    assert values(reports.kpis(quad, 20200101, 20200103)) == [(100, 50, 1.0, 50.0)]


def test_kpis_of_an_empty_range_are_zero(quad, values):
    assert values(reports.kpis(quad, 20210101, 20210103)) == [(0, 0, 0.0, 0.0)]


def test_date_range_includes_both_ends(quad, values):
    assert values(dates.in_date_range(quad, 20200102, 20200103), "event_date") == [
        (20200102,),
        (20200103,),
    ]


def test_trend(quad, values):
    assert values(reports.trend(quad, 20200101, 20200102)) == [
        (DAY(2020, 1, 1), 40, 30, -0.5),
        (DAY(2020, 1, 2), 20, 20, None),
    ]


def test_labels_of_unknown_classes(quad, values):
    labelled = reports.quad_dist(quad, 20200101, 20200103)
    assert values(labelled, "quad_class", "quad_label") == [
        (1, "Q1 Verbal Coop"),
        (3, "Q3 Verbal Conflict"),
        (4, "Q4 Material Conflict"),
        (9, "9"),
    ]
    timed = reports.quad_time(quad, 20200101, 20200103).filter("quad_class = 9")
    assert values(timed) == [(DAY(2020, 1, 3), 9, 40, "Q9")]


def test_date_bounds_and_live_flag(quad, values):
    assert values(reports.date_bounds(quad, "2020-01-10")) == [
        (20200101, 20200103, DAY(2020, 1, 1), DAY(2020, 1, 3), True)
    ]
    assert values(reports.date_bounds(quad, "2020-01-11"), "is_live") == [(False,)]


def test_dates_convert_both_ways(spark, values):
    df = spark.createDataFrame([(20240229,), (19790101,), (20261231,)], "d int")
    back = df.select("d", dates.to_ymd(dates.to_day(F.col("d"))).alias("e"))
    assert all(a == b for a, b in values(back))
    with pytest.raises(Exception, match="(?i)date|day"):
        spark.sql("select 20230230 as d").select(dates.to_day(F.col("d"))).collect()


def test_percent_of_nothing_is_zero(spark, values):
    df = spark.createDataFrame([(1, 4), (1, 0)], "a int, b int")
    assert values(df.select(labels.percent(F.col("a"), F.col("b")))) == [(0.0,), (25.0,)]


@pytest.fixture
def actors(spark):
    return spark.createDataFrame(
        [
            (20200101, "USA", 5, 1, 1.0),
            (20200102, "USA", 5, 1, 3.0),
            (20200101, "FRA", 10, 1, None),
            (20200101, "USAGOV", 99, 1, 1.0),
            (20200101, None, 99, 1, 1.0),
            (20200101, "DEU", 0, 1, 1.0),
            (20200101, "CHN", 7, 1, -1.0),
        ],
        "event_date int, source_actor string, total_events long, total_articles long,"
        " avg_goldstein double",
    )


def test_top_actors_are_countries_with_events_ties_by_name(actors):
    top = reports.top_actors(actors, 20200101, 20200131).collect()
    assert [tuple(r) for r in top] == [("FRA", 10, None), ("USA", 10, 2.0), ("CHN", 7, -1.0)]
    assert [r["iso3"] for r in reports.top_actors(actors, 20200101, 20200131, 1).collect()] == ["FRA"]
    # the comparison variant has no such filter on the sum
    assert reports.rollup_actors(actors, 20200101, 20200131).count() == 4


@pytest.fixture
def dyads(spark):
    pairs = [("A", "B", 50), ("B", "A", 40), ("A", "C", 30), ("D", "D", 20), ("E", "F", 10)]
    return spark.createDataFrame(pairs, "source_actor string, target_actor string, total_events long")


def test_heatmap_ranks_actors_by_list_rows(dyads, values):
    # list rows: A 3, B 2, D 2 (both ends of one row), then C, E, F by name
    assert values(reports.heatmap_cells(dyads, 3)) == [
        ("A", "B", 50),
        ("B", "A", 40),
        ("D", "D", 20),
    ]
    assert values(reports.heatmap_cells(dyads, 1)) == []
    assert len(values(reports.heatmap_cells(dyads, 12))) == 5


def test_heatmap_matrix_fills_with_zero(dyads):
    wide = reports.heatmap_matrix(reports.heatmap_cells(dyads, 4))
    assert wide.columns == ["source_actor", "A", "B", "C", "D"]
    assert [tuple(r) for r in wide.collect()] == [
        ("A", 0, 50, 30, 0),
        ("B", 40, 0, 0, 0),
        ("D", 0, 0, 0, 20),
    ]


def test_bottom_up_keeps_the_largest_in_rising_order(dyads):
    shown = reports.bottom_up(dyads.drop("target_actor"), 3, "source_actor").collect()
    assert [r["total_events"] for r in shown] == [30, 40, 50]


def test_compare_totals(spark, values):
    schema = "k string, total_events long, avg_goldstein double"
    before = spark.createDataFrame([("a", 1, 1.0), ("b", 2, None), (None, 3, 1.0)], schema)
    after = spark.createDataFrame([("b", 2, None), (None, 5, 1.0), ("c", 4, 1.0)], schema)
    assert values(reports.compare_totals(before, after, "k")) == [
        ("a", 1, 0, -1, "removed"),
        ("b", 2, 2, 0, "same"),
        ("c", 0, 4, 4, "added"),
        (None, 3, 5, 2, "changed"),
    ]


def test_stored_table_skips_months(spark, events, folder):
    df = events(
        *[(i, 20200101 + 100 * (i % 6), "A", "B", "010", 1, 1, 1, 1.0) for i in range(60)]
    )
    path = f"{folder}/events"
    write_events(df, path, "overwrite")
    write_events(df.filter("globaleventid < 10"), path)
    stored = read_events_table(spark, path)
    assert stored.count() == 70
    report = reports.raw_daily(stored, 20200201, 20200315)
    assert report.agg(F.sum("total_events")).head()[0] == 24
    plan = report._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "event_month" in partition_filters and "202002" in partition_filters
    write_events(df.filter("globaleventid < 10"), path, "overwrite")
    assert read_events_table(spark, path).count() == 10
    assert views.full(read_events_table(spark, path), views.QUAD).count() == 6
