from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from retally.functions.scores import mean, mean_of_means, rounded
from retally.plans import reports, views


def test_seed_rows(seed, values):
    assert values(views.full(seed, views.QUAD)) == [
        (19790101, 1, 3, 13, 3.15),
        (19790101, 2, 1, 6, 7.0),
        (19790101, 4, 2, 4, -5.0),
    ]
    assert values(views.full(seed, views.DYAD)) == [
        (19790101, "AFR", "FRA", 3, 3.15),
        (19790101, "ARG", "CHL", 2, -5.0),
        (19790101, "CHN", "CHNGOV", 1, 7.0),
    ]
    assert values(views.full(seed, views.CAMEO))[0] == (19790101, "043", 1, 4, 2.8)


def test_one_pass_gives_all_views(seed, values):
    deltas = views.delta(views.entering(seed))
    for spec in views.VIEWS.values():
        assert values(views.from_deltas(deltas, spec)) == values(views.full(seed, spec))
        assert values(views.from_signed(views.entering(seed), spec)) == values(
            views.full(seed, spec)
        )
    assert dict(values(views.group_counts(deltas))) == {
        spec.table: views.full(seed, spec).count() for spec in views.VIEWS.values()
    }
    everything = {name: views.full(seed, spec) for name, spec in views.VIEWS.items()}
    assert values(reports.view_counts(everything)) == values(views.group_counts(deltas))


def test_null_keys_stay_in_views_but_not_in_recomputation(events, values):
    df = events(
        (1, 20200101, None, "FRA", "010", 1, 1, 1, 1.0),
        (2, 20200101, "USA", None, "010", 1, 1, 1, 2.0),
        (3, 20200101, "USA", "FRA", None, 1, 1, 1, 3.0),
    )
    assert views.full(df, views.DYAD).count() == 3
    assert views.full_filtered(df, views.DYAD).count() == 1
    assert views.full(df, views.CAMEO).count() == 2
    assert views.full_filtered(df, views.CAMEO).count() == 1
    deltas = views.delta(views.entering(df))
    assert values(views.from_deltas(deltas, views.DYAD)) == values(views.full(df, views.DYAD))


def test_scores_missing_in_part_or_in_whole(events, values):
    df = events(
        (1, 20200101, "A", "B", "010", 5, 1, 1, None),
        (2, 20200101, "A", "B", "010", 1, 1, 1, 2.0),
        (3, 20200101, "A", "B", "010", 1, 1, 2, None),
    )
    # one weight per event row, whatever num_events says
    assert values(views.full(df, views.QUAD)) == [
        (20200101, 1, 6, 2, 2.0),
        (20200101, 2, 1, 1, None),
    ]


def test_no_events_no_groups(events):
    for spec in views.VIEWS.values():
        assert views.full(events(), spec).count() == 0
    assert views.delta(views.entering(events())).count() == 0


def test_mean_of_events_and_mean_of_means_differ(events, values):
    df = events(
        (1, 20200101, "USA", "B", "010", 1, 1, 1, 1.0),
        (2, 20200101, "USA", "B", "010", 1, 1, 1, 1.0),
        (3, 20200102, "USA", "B", "010", 1, 1, 1, 4.0),
    )
    raw = reports.raw_actors(df, 20200101, 20200102)
    rolled = reports.rollup_actors(views.full(df, views.ACTOR), 20200101, 20200102)
    assert values(raw) == [("USA", 3, 2.0)]
    assert values(rolled) == [("USA", 3, 2.5)]


def test_means_are_exact_in_any_order(spark):
    rows = [(0.1 * (i % 7) - 0.3,) for i in range(1000)]
    up = spark.createDataFrame(rows, "x double").repartition(3)
    down = spark.createDataFrame(rows[::-1], "x double").repartition(4)
    for function in (mean, mean_of_means):
        one, two = (rounded(df.agg(function("x").alias("m")), "m").head()[0] for df in (up, down))
        assert one == two
    exact = sum((i % 7) - 3 for i in range(1000)) / 10 / 1000
    assert rounded(up.agg(mean("x").alias("m")), "m").head()[0] == pytest.approx(exact, abs=1e-15)


def test_large_sums_are_64_bit(events, values):
    df = events(*[(i, 20200101, "A", "B", "010", 2**31 - 1, 1, 1, 1.0) for i in range(3)])
    assert values(views.full(df, views.QUAD), "total_events") == [(3 * (2**31 - 1),)]


def test_one_pair_with_a_third_of_all_rows(events, values):
    """A hot group gives exact results; brute force over the same rows."""
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        rows.append(
            (
                i,
                20200101 if hot else 20200101 + i % 5,
                "USA" if hot else f"A{i % 7}0",
                "CHN" if hot else f"B{i % 11}0",
                "010" if hot else f"{i % 13:03}",
                1 + i % 3,
                1 + i % 10,
                1 if hot else 1 + i % 4,
                None if i % 17 == 0 else (i % 201 - 100) / 10,
            )
        )
    df = events(*rows)
    columns = df.columns
    deltas = views.delta(views.entering(df.repartition(6)))
    for spec in views.VIEWS.values():
        groups = {}
        for row in rows:
            row = dict(zip(columns, row))
            groups.setdefault(tuple(row[k] for k in spec.keys), []).append(row)
        expected = []
        for key, members in groups.items():
            scores = [m["goldstein"] for m in members if m["goldstein"] is not None]
            out = [*key, sum(m["num_events"] for m in members)]
            if spec.has_articles:
                out.append(sum(m["num_articles"] for m in members))
            out.append(float(sum(map(Fraction, scores))) / len(scores) if scores else None)
            expected.append(tuple(out))
        expected.sort(key=lambda r: tuple((v is None, str(v)) for v in r))
        assert values(views.full(df, spec)) == expected
        assert values(views.from_deltas(deltas, spec)) == expected
    top = reports.raw_dyads(df, 20200101, 20200131, 1).collect()[0]
    assert (top["source_actor"], top["target_actor"]) == ("USA", "CHN")


def test_many_means_do_not_overflow(spark):
    rows = spark.range(2_000_000).select(F.lit(9.9).alias("m"))
    assert rounded(rows.agg(mean_of_means("m").alias("m")), "m").head()[0] == 9.9


def exact_mean(numbers):
    return float(sum(map(Fraction, numbers))) / len(numbers)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_means_of_any_scores_are_exact(spark, events, ansi):
    """Means are those of exact sums, rounded once: many digits, wide ranges, ties, large averages."""
    draw = random.Random(3)
    groups = [[5e-11], [0.123456, 0.1], [2500.0, 1.0], [1e18, -1e18, 3e-23], [2.0**-128], [0.1 + 0.2], [9e18] * 50]
    groups += [[sign * 2.0**53, sign, tail * 2.0**-60] for sign in (1.0, -1.0) for tail in (1.0, -1.0, 0.0)]
    for _ in range(300):
        groups.append([math.ldexp(draw.randint(-(2**53), 2**53), draw.randint(-128, 9)) for _ in range(draw.randint(1, 9))])
    df = spark.createDataFrame([(g, x) for g, own in enumerate(groups) for x in own], "g int, x double")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for function in (mean, mean_of_means):
            found = dict(map(tuple, rounded(df.groupBy("g").agg(function("x").alias("m")), "m").collect()))
            assert found == {g: exact_mean(own) for g, own in enumerate(groups)}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_what_is_retracted_leaves_nothing(events, values):
    first = events((1, 20200101, "A", "B", "043", 1, 1, 1, 0.1), (2, 20200101, "A", "B", "043", 1, 1, 1, 0.0))
    other = events((3, 20200101, "A", "B", "043", 1, 1, 1, 1e17 / 3), (4, 20200101, "A", "B", "043", 1, 1, 1, 1e-20 / 3))
    rows = views.entering(first).unionByName(views.entering(other)).unionByName(views.entering(other).withColumn("sign", F.lit(-1)))
    assert values(views.from_signed(rows, views.QUAD), "avg_goldstein") == [(0.05,)]


@pytest.mark.parametrize("score", [2.0**63, 1e-40, float("nan"), float("-inf")])
def test_a_score_is_never_cut(events, score):
    with pytest.raises(Exception, match="exact sums do not hold"):
        views.full(events((1, 20200101, "A", "B", "043", 1, 1, 1, score)), views.QUAD).collect()
