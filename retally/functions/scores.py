"""Exact averages of doubles by a superaccumulator.

A sum of doubles depends on the order of addition, so two runs of a shuffled aggregate can
differ, and adding then retracting a value can leave a residue. Here a double is cut into
digits of 32 bits at fixed places, and each place has a 64-bit sum of its own: an aggregate
column like any other, inside generated code. Order does not matter, a retraction takes
exactly away what was added, and the sum is rounded once, to the nearest double, when it is read.

The places hold doubles below 2^63 whose last bit is worth 2^-128 or more, so all of at least
3e-23 in size and many smaller ones. A score beyond that, NaN or infinity fails the job; it is
never cut. A place takes 2^31 rows of one group between two sums without overflow at the worst,
and an overflow fails under ANSI rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Worth of the last bit of each digit, as powers of two, and bits of a digit.
PLACES = (-128, -96, -64, -32, 0, 32)
DIGIT = 32
#: Largest power of two that a score stays below, and doubles from which on all are whole.
_LIMIT, _WHOLE = 2.0**63, 2.0**53

# Expressions are SQL text: they are long, and text is parsed by Spark at once.


def _double(x: float) -> str:
    return f"{x!r}D"


def _digit(value: str, place: int) -> str:
    """The digit of ``value`` at a place, with the sign of the double."""
    if place == PLACES[-1]:
        return f"CAST({value} * {_double(2.0**-place)} AS BIGINT)"
    above = f"({value} * {_double(2.0 ** -(place + DIGIT))})"
    part = f"CASE WHEN abs({above}) < {_double(_WHOLE)} THEN {above} - CAST(CAST({above} AS BIGINT) AS DOUBLE) ELSE 0D END"
    return f"CAST(({part}) * {_double(2.0**DIGIT)} AS BIGINT)"


def digits(value: str, checked: bool = True) -> list[str]:
    """SQL for the digits of a double column, one for each of PLACES. What is smaller than the last place
    is left out, or fails the job if ``checked``; so does what is too large."""
    first, *others = (_digit(value, place) for place in PLACES)
    if checked:
        units = f"({value} * {_double(2.0 ** -PLACES[0])})"
        whole = f"(abs({units}) >= {_double(_WHOLE)} OR {units} = CAST(CAST({units} AS BIGINT) AS DOUBLE))"
        error = f"raise_error(concat('a score that exact sums do not hold: ', CAST({value} AS STRING)))"
        first = f"CASE WHEN {value} IS NULL OR (abs({value}) < {_double(_LIMIT)} AND {whole}) THEN {first} ELSE CAST({error} AS BIGINT) END"
    return [first, *others]


def total(sums: Sequence[str]) -> str:
    """SQL for the double nearest to the sum, from the names of one sum for each of PLACES.

    Nearly always only the middle places count: these fit a decimal, and casting that rounds once. Else
    carries make the lower digits positive: a whole part, 64 bits behind it and 64 more. The decimal
    that holds the leading bits gets one more bit that says whether anything follows.
    """
    s0, s1, s2, s3, s4, s5 = sums
    wide, mask, shift = "CAST({} AS DECIMAL(38,0))".format, f"{(1 << DIGIT) - 1}L", f"{1 << DIGIT}L"
    t1 = f"({s1} + shiftright({s0}, {DIGIT}))"
    t2 = f"({s2} + shiftright({t1}, {DIGIT}))"
    t3 = f"({s3} + shiftright({t2}, {DIGIT}))"
    whole = f"({wide(s5)} * {shift} + {s4} + shiftright({t3}, {DIGIT}))"
    behind = f"({wide(f'({t3} & {mask})')} * {shift} + ({t2} & {mask}))"
    rest = f"({wide(f'({t1} & {mask})')} * {shift} + ({s0} & {mask}))"
    both = f"({whole} * {1 << 64}BD + {behind})"
    middle = f"(({wide(s4)} * {shift} + {s3}) * {shift} + {s2})"
    simple = f"{s0} = 0 AND {s1} = 0 AND {s5} = 0 AND abs({s4}) < {1 << 58}L"
    return (
        f"CASE WHEN {simple} THEN CAST({middle} AS DOUBLE) * {_double(2.0**-64)}"
        f" WHEN abs({whole}) >= {1 << 61}BD THEN CAST({whole} * 2 + CASE WHEN {behind} + {rest} = 0 THEN 0 ELSE 1 END AS DOUBLE) / 2D"
        f" WHEN abs({both}) >= {1 << 62}BD THEN CAST({both} * 2 + CASE WHEN {rest} = 0 THEN 0 ELSE 1 END AS DOUBLE) * {_double(2.0**-65)}"
        f" ELSE CAST({both} * {1 << 64}BD + {rest} AS DOUBLE) * {_double(2.0**-128)} END"
    )


def mean_of_sums(sums: Sequence[str], count: str) -> Column:
    """Mean from the names of the sums by place and of a count; NULL when nothing was counted."""
    return F.expr(f"({total(sums)}) / nullif({count}, 0)")


def _aggregate(value: str, checked: bool) -> Column:
    parts = ", ".join(f"'s{n}', coalesce(sum({d}), 0L)" for n, d in enumerate(digits(value, checked)))
    return F.expr(f"named_struct({parts}, 'n', count({value}))")


def mean(value: str) -> Column:
    """Aggregate: the exact sums of a double column, NULLs ignored, one weight per row. ``rounded`` makes
    the mean of it."""
    return _aggregate(value, checked=True)


def mean_of_means(average: str) -> Column:
    """Aggregate: the same for the unweighted mean of group averages (not the mean over the rows behind
    them). What an average has below 2^-128 is left out."""
    return _aggregate(average, checked=False)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the means of aggregates by ``mean`` or ``mean_of_means`` in their place."""
    means = {n: mean_of_sums([f"{n}.s{k}" for k in range(len(PLACES))], f"{n}.n") for n in names}
    return df.withColumns(means)
