"""Reports over the views, and the same questions asked of the events directly.

A report takes a view (``plans.views.full``, or a maintained view) and a date range. Averages
over a view are means of its daily averages; averages over events weigh each event alike, so
the two differ by design. Every ranking breaks ties by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import in_date_range, is_live, to_day
from ..functions.labels import (
    conflict_only,
    country_level,
    label_or_class,
    label_or_q_class,
    percent,
)
from ..functions.scores import mean, mean_of_means, rounded
from .views import VIEWS

TOP_ACTORS = 250
TOP_N = 20
TOP_RAW = 50
HEATMAP_ENDPOINTS = 12


def _total() -> F.Column:
    return F.sum("total_events").alias("total_events")


def _mean(name: str = "mean_goldstein") -> F.Column:
    """Sums of averages; ``rounded`` gives the mean."""
    return mean_of_means("avg_goldstein").alias(name)


def _top(df: DataFrame, n: int, *names: str) -> DataFrame:
    return df.orderBy(F.desc("total_events"), *names).limit(n)


def _with_keys(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


# --- over the class view -----------------------------------------------------------------


def date_bounds(quad_view: DataFrame, as_of) -> DataFrame:
    """First and last event day, and whether the data is current on the date ``as_of``."""
    bounds = quad_view.agg(
        F.min("event_date").alias("min_event_date"), F.max("event_date").alias("max_event_date")
    )
    latest = to_day(F.col("max_event_date"))
    return bounds.select(
        "*",
        to_day(F.col("min_event_date")).alias("min_day"),
        latest.alias("max_day"),
        is_live(latest, F.lit(as_of).cast("date")).alias("is_live"),
    )


def kpis(quad_view: DataFrame, start: int, end: int) -> DataFrame:
    """Total events, conflict events, mean score, conflict rate; zeros for an empty range."""
    sums = in_date_range(quad_view, start, end).agg(
        F.coalesce(_total(), F.lit(0)).alias("total_events"),
        F.coalesce(
            F.sum(conflict_only(F.col("quad_class"), F.col("total_events"))), F.lit(0)
        ).alias("conflict_events"),
        _mean(),
    )
    rate = percent(F.col("conflict_events"), F.col("total_events"))
    mean_score = F.coalesce("mean_goldstein", F.lit(0.0))
    return rounded(sums, "mean_goldstein").withColumns({"mean_goldstein": mean_score, "conflict_rate": rate})


def trend(quad_view: DataFrame, start: int, end: int) -> DataFrame:
    """Per day: events, conflict events, mean of the class averages."""
    daily = in_date_range(quad_view, start, end).groupBy("event_date").agg(
        _total(),
        F.sum(conflict_only(F.col("quad_class"), F.col("total_events"))).alias("conflict_events"),
        _mean(),
    )
    day = to_day(F.col("event_date")).alias("event_day")
    shown = rounded(daily, "mean_goldstein")
    return shown.select(day, "total_events", "conflict_events", "mean_goldstein").orderBy("event_day")


def quad_dist(quad_view: DataFrame, start: int, end: int) -> DataFrame:
    """Per class with its label: events and mean of the daily averages."""
    per_class = in_date_range(quad_view, start, end).groupBy("quad_class")
    sums = per_class.agg(_total(), _mean("avg_goldstein"))
    labelled = rounded(sums, "avg_goldstein").withColumn("quad_label", label_or_class(F.col("quad_class")))
    return labelled.orderBy("quad_class")


def quad_time(quad_view: DataFrame, start: int, end: int) -> DataFrame:
    """Per day and class with its label: events."""
    sums = in_date_range(quad_view, start, end).groupBy("event_date", "quad_class").agg(_total())
    return sums.select(
        to_day(F.col("event_date")).alias("event_day"),
        "quad_class",
        "total_events",
        label_or_q_class(F.col("quad_class")).alias("quad_label"),
    ).orderBy("event_day", "quad_class")


# --- over the actor, pair and code views -------------------------------------------------


def top_actors(actor_view: DataFrame, start: int, end: int, n: int = TOP_ACTORS) -> DataFrame:
    """Busiest country-level source actors."""
    countries = _with_keys(in_date_range(actor_view, start, end), "source_actor").filter(
        country_level(F.col("source_actor"))
    )
    sums = countries.groupBy(F.col("source_actor").alias("iso3")).agg(_total(), _mean())
    return rounded(_top(sums.filter(F.col("total_events") > 0), n, "iso3"), "mean_goldstein")


def top_dyads(dyad_view: DataFrame, start: int, end: int, n: int = TOP_N) -> DataFrame:
    """Busiest ordered pairs of actors."""
    pair = ("source_actor", "target_actor")
    sums = _with_keys(in_date_range(dyad_view, start, end), *pair).groupBy(*pair)
    return rounded(_top(sums.agg(_total(), _mean()), n, *pair), "mean_goldstein")


def top_cameo(cameo_view: DataFrame, start: int, end: int, n: int = TOP_N) -> DataFrame:
    """Busiest event codes."""
    sums = _with_keys(in_date_range(cameo_view, start, end), "cameo_code").groupBy("cameo_code")
    return rounded(_top(sums.agg(_total(), _mean()), n, "cameo_code"), "mean_goldstein")


def bottom_up(top: DataFrame, n: int, name: str) -> DataFrame:
    """The ``n`` largest of a list in ascending order, as a bar chart shows them."""
    return _top(top, n, name).orderBy("total_events", F.desc(name))


def heatmap_cells(dyads: DataFrame, endpoints: int = HEATMAP_ENDPOINTS) -> DataFrame:
    """Pairs of a top-pairs list whose two ends are both among its most frequent actors.

    Actors are ranked by the number of list rows they appear in. The list is short (it is a
    top-n), so it is read once and ranked with windows instead of being joined to itself.
    """
    ends = dyads.select("*", F.explode(F.array("source_actor", "target_actor")).alias("end"))
    counted = ends.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("end")))
    ranked = counted.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n"), "end")))
    pairs = ranked.groupBy("source_actor", "target_actor").agg(
        F.max("total_events").alias("total_events"), F.max("rank").alias("worst")
    )
    return pairs.filter(F.col("worst") <= endpoints).drop("worst")


def heatmap_matrix(cells: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Cells as a matrix: a row per source, a column per target, 0 where there is no pair.

    Without ``targets`` they are looked up first (at most the heatmap's endpoints).
    """
    if targets is None:
        found = cells.select("target_actor").distinct().orderBy("target_actor").collect()
        targets = [row["target_actor"] for row in found]
    wide = cells.groupBy("source_actor").pivot("target_actor", targets).agg(F.sum("total_events"))
    return wide.fillna(0).orderBy("source_actor")


def heatmap_grid(cells: DataFrame) -> DataFrame:
    """Every source with every target of the heatmap, 0 where there is no pair."""
    wide = heatmap_matrix(cells)
    targets = [c for c in wide.columns if c != "source_actor"]
    if not targets:
        return cells.select("source_actor", "target_actor", "total_events")
    return wide.unpivot(["source_actor"], targets, "target_actor", "total_events")


def rollup_daily(quad_view: DataFrame, start: int, end: int) -> DataFrame:
    """Events per day and class, from the view."""
    sums = in_date_range(quad_view, start, end).groupBy("event_date", "quad_class")
    return rounded(sums.agg(_total(), _mean("avg_goldstein")), "avg_goldstein")


def rollup_actors(actor_view: DataFrame, start: int, end: int, n: int = TOP_ACTORS) -> DataFrame:
    """Busiest country-level source actors, from the view."""
    countries = _with_keys(in_date_range(actor_view, start, end), "source_actor").filter(
        country_level(F.col("source_actor"))
    )
    sums = countries.groupBy("source_actor").agg(_total(), _mean("avg_goldstein"))
    return rounded(_top(sums, n, "source_actor"), "avg_goldstein")


def rollup_dyads(dyad_view: DataFrame, start: int, end: int, n: int = TOP_RAW) -> DataFrame:
    """Busiest pairs, from the view."""
    return top_dyads(dyad_view, start, end, n).withColumnRenamed("mean_goldstein", "avg_goldstein")


def rollup_cameo(cameo_view: DataFrame, start: int, end: int, n: int = TOP_RAW) -> DataFrame:
    """Busiest codes, from the view."""
    return top_cameo(cameo_view, start, end, n).withColumnRenamed("mean_goldstein", "avg_goldstein")


def dashboard(
    views: dict[str, DataFrame], start: int, end: int, n: int = TOP_N
) -> dict[str, DataFrame]:
    """All reports of one page by name, from the four views (``ViewStore.views`` gives them as
    of the same batch)."""
    dyads = top_dyads(views["dyad"], start, end, n)
    return {
        "kpis": kpis(views["quad"], start, end),
        "trend": trend(views["quad"], start, end),
        "actors": top_actors(views["actor"], start, end),
        "dyads": dyads,
        "cameo": top_cameo(views["cameo"], start, end, n),
        "quad_dist": quad_dist(views["quad"], start, end),
        "quad_time": quad_time(views["quad"], start, end),
        "heatmap": heatmap_cells(dyads),
    }


# --- over the events ---------------------------------------------------------------------


def _raw(events: DataFrame, start: int, end: int, *keys: str) -> DataFrame:
    """Events and sums of scores by key; callers round the means of the rows they show."""
    sums = in_date_range(events, start, end).groupBy(*keys)
    return sums.agg(
        F.sum(F.col("num_events").cast("bigint")).alias("total_events"),
        mean("goldstein").alias("avg_goldstein"),
    )


def raw_daily(events: DataFrame, start: int, end: int) -> DataFrame:
    """Events per day and class, from the events."""
    return rounded(_raw(events, start, end, "event_date", "quad_class"), "avg_goldstein")


def raw_actors(events: DataFrame, start: int, end: int, n: int = TOP_ACTORS) -> DataFrame:
    """Busiest country-level source actors, from the events."""
    countries = _with_keys(events, "source_actor").filter(country_level(F.col("source_actor")))
    return rounded(_top(_raw(countries, start, end, "source_actor"), n, "source_actor"), "avg_goldstein")


def raw_dyads(events: DataFrame, start: int, end: int, n: int = TOP_RAW) -> DataFrame:
    """Busiest pairs, from the events."""
    pair = ("source_actor", "target_actor")
    return rounded(_top(_raw(_with_keys(events, *pair), start, end, *pair), n, *pair), "avg_goldstein")


def raw_cameo(events: DataFrame, start: int, end: int, n: int = TOP_RAW) -> DataFrame:
    """Busiest codes, from the events."""
    top = _top(_raw(_with_keys(events, "cameo_code"), start, end, "cameo_code"), n, "cameo_code")
    return rounded(top, "avg_goldstein")


# --- about the views ---------------------------------------------------------------------


def view_counts(views: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each view, by table name."""
    counts = None
    for name, view in views.items():
        one = view.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(VIEWS[name].table).alias("table_name"), "n_rows"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def compare_totals(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Totals of each group before and after, with the difference and what happened to it.

    NULL keys match each other.
    """
    match = None
    for key in keys:
        same = F.col(f"b.{key}").eqNullSafe(F.col(f"a.{key}"))
        match = same if match is None else match & same
    b = before.withColumn("_in", F.lit(True)).alias("b")
    a = after.withColumn("_in", F.lit(True)).alias("a")
    was, now = F.col("b._in").isNotNull(), F.col("a._in").isNotNull()
    joined = b.join(a, match, "full")
    out = [F.when(now, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    for c in ("total_events", "total_articles"):
        if c in before.columns and c in after.columns:
            old, new = F.coalesce(F.col(f"b.{c}"), F.lit(0)), F.coalesce(F.col(f"a.{c}"), F.lit(0))
            out += [old.alias(f"{c}_before"), new.alias(f"{c}_after"), (new - old).alias(f"{c}_diff")]
    same_rows = F.lit(True)
    for c in before.columns:
        if c not in keys and c != "last_updated":
            same_rows = same_rows & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    status = (
        F.when(~was, "added").when(~now, "removed").when(same_rows, "same").otherwise("changed")
    )
    return joined.select(*out, status.alias("status"))
