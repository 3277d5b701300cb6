"""Tab-separated event files: two layouts, stray bytes, typed rows, surrogate ids.

A line has 17 fields, or 11 when the source and target positions are left out (8 event
fields, then the action position). Lines with any other number of fields are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVENT_COLUMNS, KEY, LINE_FIELDS
from .lines import data_lines, number_rows, read_lines, slice_lines

FULL = 17
SHORT = 11

_LEADING = 8  # fields before the positions, the same in both layouts
_ACTION = 14  # index of the first action position field in the full layout

_NAMES = [name for name, _, _ in LINE_FIELDS]

# A cast to double also takes NaN, infinity and a trailing type letter; here the only letter
# in a number is the exponent's.
_LETTERS = "[a-df-zA-DF-Z]"


def split_fields(value: Column) -> Column:
    """Fields of a line after removing NUL and carriage return characters."""
    return F.split(F.translate(value, "\r\0", ""), "\t", -1)


def detect_layout(lines: DataFrame) -> int:
    """The layout of the data lines: short only if it is strictly more common. Runs one
    aggregate over all lines, of two numbers."""
    return _layout_of(data_lines(lines))


def _layout_of(data: DataFrame) -> int:
    n = F.size(split_fields(F.col("value")))
    seen = data.agg(F.count_if(n == SHORT).alias("short"), F.count_if(n == FULL).alias("full")).head()
    return SHORT if seen["short"] > seen["full"] else FULL


def _text(index: int, layout: int) -> Column:
    """Text of the field that belongs into column ``index``."""
    fields, n = F.col("_fields"), F.size("_fields")
    if index < _LEADING:
        return F.get(fields, F.lit(index))
    if index >= _ACTION:
        return F.get(fields, n - F.lit(FULL - index))  # the last three fields in both layouts
    if layout == FULL:
        return F.when(n == FULL, F.get(fields, F.lit(index)))
    return F.lit(None).cast("string")


def parse(lines: DataFrame, layout: int = FULL) -> DataFrame:
    """Lines as typed columns, with ``problem``: NULL, or the name of the first bad field.

    Lines of any other size than the two layouts give no row. An empty field is NULL. With
    the short layout the source and target positions of full lines are left out.
    """
    if layout not in (FULL, SHORT):
        raise ValueError(f"layout must be {FULL} or {SHORT}, not {layout}")
    others = lines.columns
    split = lines.select(*others, split_fields(F.col("value")).alias("_split"))
    fitting = F.when(F.size("_split").isin(FULL, SHORT), F.array("_split"))
    sized = split.select(*others, F.explode(fitting).alias("_fields"))
    texts = {name: _text(i, layout) for i, (name, _, _) in enumerate(LINE_FIELDS)}
    typed = sized.select(
        *others,
        "_fields",
        *[_typed(texts[name], kind).alias(name) for name, kind, _ in LINE_FIELDS],
    )
    problems = []
    for name, _, nullable in LINE_FIELDS:
        bad = F.col(name).isNull()
        if nullable:
            bad = bad & (texts[name] != "")
        problems.append(F.when(bad, F.lit(name)))
    doubles = [texts[name] for name, kind, _ in LINE_FIELDS if isinstance(kind, T.DoubleType)]
    not_numbers = F.concat_ws(" ", *doubles).rlike(_LETTERS)
    problems.append(F.when(not_numbers, F.lit("goldstein or a position")))
    return typed.select(*others, *_NAMES, F.coalesce(*problems).alias("problem"))


def _typed(text: Column, kind: T.DataType) -> Column:
    """The value of a field; NULL if the text is empty or not of the type."""
    return F.nullif(text, F.lit("")) if isinstance(kind, T.StringType) else text.try_cast(kind)


def events_of(parsed: DataFrame, on_bad: str = "fail") -> DataFrame:
    """The events among parsed lines. A bad line fails the job (``'fail'``) or is left out
    (``'skip'``).

    Each line gives one row or none through ``explode``. A filter would be moved towards the
    scan instead: lines would be parsed again inside it, and lines that an earlier step
    leaves out would be checked too.
    """
    problem, event = F.col("problem"), F.array(F.struct(*_NAMES))
    good = F.when(problem.isNull(), event)
    if on_bad == "fail":
        message = F.concat(F.lit("bad event line, "), problem, F.lit(": "), F.col("value"))
        kind = T.ArrayType(T.StructType([T.StructField(n, k) for n, k, _ in LINE_FIELDS]))
        good = good.otherwise(F.raise_error(message).cast(kind))
    elif on_bad != "skip":
        raise ValueError("on_bad must be 'fail' or 'skip'")
    others = [c for c in parsed.columns if c not in (*_NAMES, "problem", "value")]
    return parsed.select(*others, F.explode(good).alias("_event")).select(*others, "_event.*")


def rejects_of(parsed: DataFrame) -> DataFrame:
    """Lines of a right size with a bad field, and which field it is."""
    rejected = F.when(F.col("problem").isNotNull(), F.array(F.struct("value", "problem")))
    return parsed.select(F.explode(rejected).alias("_r")).select("_r.*")


def max_id(events: DataFrame) -> int:
    """Largest id in the table, 0 for an empty one. Runs a query."""
    return events.agg(F.coalesce(F.max(KEY), F.lit(0)).alias("m")).head()["m"]


def assign_ids(events: DataFrame, after: int, gapless: bool = True) -> DataFrame:
    """Rows with ids above ``after``, and the event columns.

    Gapless ids are ``after + 1``, ``after + 2``, ... in input order and need a counting pass
    over the input. Without it ids are unique and rise within a split, but leave gaps, as a
    database sequence may; the input is read once.
    """
    if gapless:
        return number_rows(events, KEY, start=after + 1).select(*EVENT_COLUMNS)
    first = F.lit(after + 1).cast("long")
    return events.withColumn(KEY, first + F.monotonically_increasing_id()).select(*EVENT_COLUMNS)


def read_events(
    spark: SparkSession,
    path: str,
    *,
    offset: int | None = None,
    limit: int | None = None,
    layout: int | None = None,
    after_id: int = 0,
    gapless_ids: bool = True,
    on_bad: str = "fail",
) -> DataFrame:
    """Events of a text file, or of the data lines ``offset .. offset + limit - 1``.

    The layout is detected unless given; ids are given as by ``assign_ids``.
    ``on_bad='skip'`` leaves unusable lines out (``rejected_lines`` shows them); ``'fail'``
    fails the job that reads them. Runs small queries for the layout and the row numbers.
    """
    parsed = _parse_file(spark, path, offset, limit, layout)
    return assign_ids(events_of(parsed, on_bad), after_id, gapless_ids)


def rejected_lines(
    spark: SparkSession,
    path: str,
    *,
    offset: int | None = None,
    limit: int | None = None,
    layout: int | None = None,
) -> DataFrame:
    """The lines ``read_events(on_bad='skip')`` leaves out, with the name of the bad field."""
    return rejects_of(_parse_file(spark, path, offset, limit, layout))


def _parse_file(spark, path, offset, limit, layout) -> DataFrame:
    lines = read_lines(spark, path)
    data = None
    if layout is None or (offset is None and limit is None):
        data = data_lines(lines)
    if layout is None:
        layout = _layout_of(data)
    if offset is not None or limit is not None:
        data = slice_lines(lines, offset or 0, limit)
    return parse(data, layout)


def line_report(lines: DataFrame) -> DataFrame:
    """Number of data lines by field count, and whether lines of that size are loaded."""
    n = F.size(split_fields(F.col("value")))
    counts = data_lines(lines).groupBy(n.alias("n_fields")).agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.withColumn("loaded", F.col("n_fields").isin(FULL, SHORT))


def write_lines(events: DataFrame, path: str, layout: int = FULL) -> None:
    """Events as tab-separated text in the given layout, a header in every file."""
    kept = [
        name
        for i, (name, _, _) in enumerate(LINE_FIELDS)
        if layout == FULL or i < _LEADING or i >= _ACTION
    ]
    events.select(*kept).write.mode("errorifexists").option("sep", "\t").option(
        "header", True
    ).option("emptyValue", "").option("quote", "\u0000").csv(path)
