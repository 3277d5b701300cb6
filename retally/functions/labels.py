"""Class labels, the conflict test and small guarded calculations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of the four event classes.
QUAD_LABELS = {
    1: "Q1 Verbal Coop",
    2: "Q2 Material Coop",
    3: "Q3 Verbal Conflict",
    4: "Q4 Material Conflict",
}

# The classes that count as conflict.
CONFLICT_CLASSES = (3, 4)


def _label(quad_class: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in QUAD_LABELS.items() for x in pair])
    return F.try_element_at(labels, quad_class)


def label_or_class(quad_class: Column) -> Column:
    """Label of a class; the bare number for a class without one."""
    return F.coalesce(_label(quad_class), quad_class.cast("string"))


def label_or_q_class(quad_class: Column) -> Column:
    """Label of a class; ``Q`` and the number for a class without one."""
    return F.coalesce(_label(quad_class), F.concat(F.lit("Q"), quad_class.cast("string")))


def conflict_only(quad_class: Column, amount: Column) -> Column:
    """``amount`` for conflict classes, 0 for the others."""
    return F.when(quad_class.isin(*CONFLICT_CLASSES), amount).otherwise(F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; 0 when there is no whole."""
    return F.when(whole != 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def country_level(actor: Column) -> Column:
    """True for three-character actor codes (longer codes name a part of a country)."""
    return F.char_length(actor) == F.lit(3)
