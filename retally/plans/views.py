"""The four daily views: full computation, change deltas, and the merge of deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators.changelog import signed_rows


@dataclass(frozen=True)
class ViewSpec:
    """A view: short name, table name, group keys, and whether it shows articles."""

    name: str
    table: str
    keys: tuple[str, ...]
    has_articles: bool = True


QUAD = ViewSpec("quad", "daily_event_volume_by_quadclass", ("event_date", "quad_class"))
DYAD = ViewSpec(
    "dyad", "dyad_interactions", ("event_date", "source_actor", "target_actor"), has_articles=False
)
ACTOR = ViewSpec("actor", "top_actors", ("event_date", "source_actor"))
CAMEO = ViewSpec("cameo", "daily_cameo_metrics", ("event_date", "cameo_code"))

VIEWS = {spec.name: spec for spec in (QUAD, DYAD, ACTOR, CAMEO)}

ALL_KEYS = ("event_date", "quad_class", "source_actor", "target_actor", "cameo_code")
MEASURED = ("num_events", "num_articles", "goldstein")
#: Sums of the digits of scores, by place.
SCORE_SUMS = tuple(f"d_score_{n}" for n in range(len(scores.PLACES)))
SUMS = ("d_events", "d_articles", *SCORE_SUMS, "d_scored", "d_rows")


def _measures(sign: Column) -> list[Column]:
    """What one event adds to each sum, as whole numbers."""
    score, none = F.col("goldstein"), F.lit(0).cast("bigint")
    parts = zip(SCORE_SUMS, map(F.expr, scores.digits("goldstein")))
    return [
        (sign * F.col("num_events").cast("bigint")).alias("d_events"),
        (sign * F.col("num_articles").cast("bigint")).alias("d_articles"),
        *[F.coalesce(sign * part, none).alias(name) for name, part in parts],
        F.when(score.isNotNull(), sign).otherwise(none).alias("d_scored"),
        sign.alias("d_rows"),
    ]


def _add_up() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def _shown(df: DataFrame, spec: ViewSpec, *extra: str) -> DataFrame:
    """Result columns of a view from its sums."""
    columns = [F.col("d_events").alias("total_events")]
    if spec.has_articles:
        columns.append(F.col("d_articles").alias("total_articles"))
    columns.append(scores.mean_of_sums(SCORE_SUMS, "d_scored").alias("avg_goldstein"))
    return df.select(*spec.keys, *columns, *extra)


def full(events: DataFrame, spec: ViewSpec) -> DataFrame:
    """A view computed from all events. NULL keys form groups of their own."""
    rows = events.select(*spec.keys, *_measures(F.lit(1).cast("bigint")))
    return _shown(rows.groupBy(*spec.keys).agg(*_add_up()), spec)


def full_filtered(events: DataFrame, spec: ViewSpec) -> DataFrame:
    """A view computed from all events whose actor and code keys are set, without articles:
    the recomputation that incremental maintenance is measured against."""
    nullable = [k for k in spec.keys if k not in ("event_date", "quad_class")]
    kept = events
    for key in nullable:
        kept = kept.filter(F.col(key).isNotNull())
    return full(kept, spec).select(*spec.keys, "total_events", "avg_goldstein")


def _view_name() -> Column:
    """Name of the view a grouping-sets row belongs to."""
    name = None
    for spec in VIEWS.values():
        grouping = sum(
            1 << (len(ALL_KEYS) - 1 - i) for i, key in enumerate(ALL_KEYS) if key not in spec.keys
        )
        is_it = F.grouping_id() == F.lit(grouping)
        name = F.when(is_it, spec.name) if name is None else name.when(is_it, spec.name)
    return name


def delta(rows: DataFrame) -> DataFrame:
    """What signed rows add to each group of each view: keys of all views (NULL where a view
    lacks the key), the sums, and the ``view`` name.

    The four groupings are one grouping-sets aggregate: one scan, one shuffle, and partial
    sums before it, so a key that holds a large part of the rows costs no more than others.
    """
    measured = rows.select(*ALL_KEYS, *_measures(F.col("sign").cast("bigint")))
    sets = [[F.col(k) for k in spec.keys] for spec in VIEWS.values()]
    grouped = measured.groupingSets(sets, *[F.col(k) for k in ALL_KEYS])
    return grouped.agg(*_add_up(), _view_name().alias("view"))


def entering(events: DataFrame) -> DataFrame:
    """All rows of a table as signed rows that enter."""
    return events.select(F.lit(1).alias("sign"), *ALL_KEYS, *MEASURED)


def signed(changes: DataFrame) -> DataFrame:
    """Change records as signed rows, with the columns the views need."""
    return signed_rows(changes, [*ALL_KEYS, *MEASURED])


def from_signed(rows: DataFrame, spec: ViewSpec) -> DataFrame:
    """One view directly from signed rows; groups left without rows disappear."""
    measured = rows.select(*spec.keys, *_measures(F.col("sign").cast("bigint")))
    return _shown(merge(measured, *spec.keys), spec)


def merge(deltas: DataFrame, *keys: str, latest: str | None = None) -> DataFrame:
    """Deltas of the same groups added up; groups left without rows disappear."""
    sums = _add_up()
    if latest is not None:
        sums.append(F.max(latest).alias(latest))
    return deltas.groupBy(*keys).agg(*sums).filter(F.col("d_rows") != 0)


def _named_latest(df: DataFrame, spec: ViewSpec, latest: str | None) -> DataFrame:
    if latest is None:
        return _shown(df, spec)
    return _shown(df.withColumnRenamed(latest, "last_updated"), spec, "last_updated")


def from_deltas(deltas: DataFrame, spec: ViewSpec, latest: str | None = None) -> DataFrame:
    """A view from deltas; ``latest`` names a time column shown as ``last_updated``."""
    own = deltas.filter(F.col("view") == spec.name)
    return _named_latest(merge(own, *spec.keys, latest=latest), spec, latest)


def from_merged(merged: DataFrame, spec: ViewSpec, latest: str | None = None) -> DataFrame:
    """A view from deltas with one row per group already: no shuffle."""
    own = merged.filter((F.col("view") == spec.name) & (F.col("d_rows") != 0))
    return _named_latest(own, spec, latest)


def group_counts(deltas: DataFrame) -> DataFrame:
    """Number of groups of each view by table name, from deltas of a single batch."""
    counts = deltas.groupBy("view").agg(F.count(F.lit(1)).alias("n_rows"))
    table = None
    for spec in VIEWS.values():
        hit = F.col("view") == spec.name
        table = F.when(hit, spec.table) if table is None else table.when(hit, spec.table)
    return counts.select(table.alias("table_name"), "n_rows")
