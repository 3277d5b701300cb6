from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from retally.catalog.queries import _write_text
from retally.schemas import EVENT_COLUMNS
from retally.sources import event_text as text
from retally.sources import lines

HEADER = "Date\tSource\tTarget\tCode\tNumEvents\tNumArts\tQuad\tGoldstein" + "\tx" * 9
GEO = ("1", "-34", "-64", "1", "-30", "-71", "4", "-34.5", "-64.25")


def full(date="20200101", source="USA", score="1.5", geo=GEO, **other):
    fields = [date, source, "FRA", "043", "1", "4", "2", score, *geo]
    for index, value in other.items():
        fields[int(index[1:])] = value
    return "\t".join(fields)


def short(date="20200101", source="USA", geo=GEO[6:]):
    return "\t".join([date, source, "FRA", "043", "1", "4", "2", "1.5", *geo])


@pytest.fixture
def file(folder):
    def write(*rows, name="events.txt", header=HEADER, end="\n"):
        path = os.path.join(folder, name)
        with open(path, "w", newline="") as out:
            out.write("\n".join([header, *rows]) + end)
        return path

    return write


def layout(spark, path):
    return text.detect_layout(lines.read_lines(spark, path))


def test_full_lines(spark, file, values):
    path = file(full(), full(source="CHN", score="", geo=("",) * 9))
    loaded = text.read_events(spark, path)
    assert loaded.columns == EVENT_COLUMNS
    assert values(loaded) == [
        (1, 20200101, "USA", "FRA", "043", 1, 4, 2, 1.5, 1, -34.0, -64.0, 1, -30.0, -71.0, 4, -34.5, -64.25),
        (2, 20200101, "CHN", "FRA", "043", 1, 4, 2, None) + (None,) * 9,
    ]


def test_short_lines_fill_the_last_three(spark, file, values):
    path = file(short(), short(source="CHN"))
    assert layout(spark, path) == text.SHORT
    loaded = values(text.read_events(spark, path))
    assert loaded[0] == (1, 20200101, "USA", "FRA", "043", 1, 4, 2, 1.5) + (None,) * 6 + (4, -34.5, -64.25)


@pytest.mark.parametrize(
    ("n_full", "n_short", "expected"), [(3, 1, 17), (1, 3, 11), (2, 2, 17), (0, 0, 17)]
)
def test_layout_is_the_more_common_one(spark, file, n_full, n_short, expected):
    path = file(*[full()] * n_full, *[short()] * n_short)
    assert layout(spark, path) == expected


def test_layout_counts_all_lines(spark, file, values):
    path = file(*[short()] * 300, *[full()] * 400)
    assert layout(spark, path) == text.FULL
    loaded = text.read_events(spark, path, gapless_ids=False)
    assert loaded.filter("source_geo_type IS NOT NULL").count() == 400


def test_only_the_first_line_of_each_file_is_a_header(spark, file, folder):
    """Data lines may equal it, and files may have different ones."""
    file(*[HEADER] * 0, full(), full(), name="a.txt")
    with open(f"{folder}/equal.txt", "w") as out:
        out.write("\n".join([full()] * 5) + "\n")
    with open(f"{folder}/other.txt", "w") as out:
        out.write("\n".join(["x" + HEADER, full(source="CHN")]) + "\n")
    for path, n in ((f"{folder}/equal.txt", 4), (f"{folder}/other.txt", 1), (folder, 7)):
        whole = text.read_events(spark, path)
        assert whole.count() == text.read_events(spark, path, offset=0).count() == n


def test_numbers_need_no_collected_splits_and_no_window_over_all(spark, file):
    df = lines.number_lines(lines.read_lines(spark, file(*[full()] * 5)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "Window" not in plan


def test_mixed_file_keeps_both(spark, file, values):
    path = file(full(source="AAA"), short(source="BBB"), full(source="CCC"))
    loaded = text.read_events(spark, path).select("source_actor", "source_geo_type", "action_geo_type")
    assert values(loaded) == [("AAA", 1, 4), ("BBB", None, 4), ("CCC", 1, 4)]


def test_mostly_short_file_drops_positions_of_full_lines(spark, file, values):
    path = file(full(source="AAA"), short(source="BBB"), short(source="CCC"))
    loaded = text.read_events(spark, path).select("source_actor", "source_geo_type", "action_geo_lat")
    assert values(loaded) == [("AAA", None, -34.5), ("BBB", None, -34.5), ("CCC", None, -34.5)]


def test_other_sizes_are_dropped_and_counted(spark, file, values):
    path = file(full(), full().rsplit("\t", 5)[0], "", "x", full() + "\t", short())
    assert [r[0] for r in values(text.read_events(spark, path), "globaleventid")] == [1, 2]
    report = text.line_report(lines.read_lines(spark, path))
    assert values(report) == [
        (1, 2, False),
        (11, 1, True),
        (12, 1, False),
        (17, 1, True),
        (18, 1, False),
    ]


def test_stray_bytes_are_removed_and_do_not_end_lines(spark, file, values):
    path = file(full(source="U\0S\rA") + "\r", "\0" + full(source="FRA"))
    assert values(text.read_events(spark, path), "source_actor", "action_geo_long") == [
        ("FRA", -64.25),
        ("USA", -64.25),
    ]


def test_no_final_newline_and_no_data(spark, file):
    assert text.read_events(spark, file(full(), end="")).count() == 1
    assert text.read_events(spark, file(name="empty.txt")).count() == 0


@pytest.mark.parametrize(
    ("line", "field"),
    [
        (full(date="2020-01-01"), "event_date"),
        (full(date=""), "event_date"),
        (full(date="99999999999"), "event_date"),
        (full(source=""), "source_actor"),
        (full(_2=""), "target_actor"),
        (full(_4="1.5"), "num_events"),
        (full(score="abc"), "goldstein"),
        (full(score="NaN"), "goldstein or a position"),
        (full(score="1.0d"), "goldstein or a position"),
        (full(_16="Infinity"), "goldstein or a position"),
        (full(_8="x"), "source_geo_type"),
    ],
)
def test_bad_fields(spark, file, values, line, field):
    path = file(full(), line, full(source="CHN"))
    with pytest.raises(Exception, match=f"bad event line, {field}: "):
        text.read_events(spark, path).collect()
    kept = text.read_events(spark, path, on_bad="skip")
    assert values(kept, "globaleventid", "source_actor") == [(1, "USA"), (2, "CHN")]
    assert values(text.rejected_lines(spark, path)) == [(line, field)]


def test_numbers_of_all_forms(spark, file, values):
    path = file(full(score="-1e-1", _9="+.5", _10="5.", _4=" 7 "))
    row = values(text.read_events(spark, path), "goldstein", "source_geo_lat", "source_geo_long", "num_events")
    assert row == [(-0.1, 0.5, 5.0, 7)]


def test_slices_count_lines_before_any_is_dropped(spark, file, values):
    rows = [full(source=f"A{i:02}") for i in range(10)]
    rows[3] = "too\tshort"
    path = file(*rows)

    def sources(**where):
        return [r[0] for r in values(text.read_events(spark, path, **where), "source_actor")]

    assert sources(offset=2, limit=3) == ["A02", "A04"]
    assert sources(offset=8) == ["A08", "A09"]
    assert sources(limit=1) == ["A00"]
    assert sources(offset=50, limit=5) == []


def test_slices_skip_the_header_without_checking_it(spark, file):
    path = file(full(), header="\t".join(["not"] * 17))
    assert text.read_events(spark, path, offset=0, limit=5).count() == 1


def test_positions_over_many_splits_and_files(spark, file, values, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        file(*[full(source=f"A{i:03}") for i in range(100)], name="a.txt")
        file(*[full(source=f"B{i:03}") for i in range(37)], name="b.txt")
        read = lines.read_lines(spark, folder)
        assert read.rdd.getNumPartitions() > 3
        numbered = lines.number_lines(read)
        places = values(numbered, "data_no", F.split("value", "\t")[1])
        expected = [f"A{i:03}" for i in range(100)] + [f"B{i:03}" for i in range(37)]
        assert sorted(places) == list(enumerate(expected))
        loaded = text.read_events(spark, folder, after_id=1000)
        assert sorted(values(loaded, "globaleventid", "source_actor")) == [
            (1001 + i, source) for i, source in enumerate(expected)
        ]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ids_follow_the_stored_ones(spark, seed, file, values):
    path = file(full(), full())
    after = text.max_id(seed)
    assert values(text.read_events(spark, path, after_id=after), "globaleventid") == [(5,), (6,)]
    assert text.max_id(seed.limit(0)) == 0


def test_ids_with_gaps_are_unique_and_above(spark, file, values):
    path = file(full(), full(), full())
    ids = [r[0] for r in values(text.read_events(spark, path, after_id=9, gapless_ids=False), "globaleventid")]
    assert len(set(ids)) == 3 and min(ids) == 10


def test_written_lines_read_back(spark, file, values, folder):
    path = file(full(), full(source="CHN", score="", geo=("",) * 9))
    loaded = text.read_events(spark, path)
    for layout_size in (text.FULL, text.SHORT):
        out = f"{folder}/out{layout_size}"
        text.write_lines(loaded, out, layout_size)
        again = text.read_events(spark, out, layout=layout_size)
        kept = [c for c in EVENT_COLUMNS[1:] if layout_size == text.FULL or "source_geo" not in c and "target_geo" not in c]
        assert values(again, *kept) == values(loaded, *kept)


def test_lines_are_parsed_once(spark, file):
    """The text is split in one place of the plan, not again inside a filter."""
    df = text.events_of(text.parse(lines.data_lines(lines.read_lines(spark, file(full())))))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_rarer_layout_first_is_written_by_many_tasks(spark, folder):
    """Lines of one layout do not meet in one task, however many there are, and none is lost."""
    kind = "element_at(array('view', 'click', 'signup', 'purchase', 'error', NULL), cast(id % 6 + 1 as int)) as event_type"
    others = ("id as event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "id % 7 as user_id", "cast(id as double) as value")
    spark.range(0, 3000, 1, 8).selectExpr(*others, kind).write.parquet(f"{folder}/events.parquet")
    _write_text(spark, folder, f"{folder}/late", False, rare_first=True)
    found = []
    for name in sorted(n for n in os.listdir(f"{folder}/late") if n.startswith("part-")):
        with open(f"{folder}/late/{name}", newline="") as part:
            found.append([line.count("\t") + 1 for line in part.read().split("\n")[1:-1]])
    sizes = [n for part in found for n in part]
    assert sizes == [text.SHORT] * 500 + [n for n in sizes[500:] if n != text.SHORT] and len(sizes) == 3000
    assert sum(map(bool, found)) > 4 and max(map(len, found)) < 1000
