"""Changes of a keyed table: update, delete, insert, upsert, all set-based.

No join here carries a broadcast hint: Spark broadcasts the small side when its size is
known to be below the session's threshold and shuffles both sides on the key otherwise. Keys
are unique in the table, so a shuffle on the key is even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEY
from ..session import written


def latest_patch(patch: DataFrame, order: str, key: str = KEY) -> DataFrame:
    """One patch row per key: the one with the largest ``order``, as if applied in turn."""
    values = [c for c in patch.columns if c not in (key, order)]
    newest = patch.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("p"))
    return newest.select(key, *[F.col(f"p.{c}").alias(c) for c in values])


def apply_updates(base: DataFrame, patch: DataFrame, key: str = KEY) -> DataFrame:
    """``base`` with the columns of matching ``patch`` rows put in (a NULL in the patch is
    put in as well). ``patch`` holds the key, at most once, and the new columns."""
    values = [c for c in patch.columns if c != key]
    renamed = patch.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in values]
    )
    joined = base.join(renamed, base[key] == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in base.columns
        ]
    )


def update_where(base: DataFrame, condition: Column, **new_values: Column) -> DataFrame:
    """``base`` with expressions put in where ``condition`` holds."""
    return base.select(
        *[
            F.when(condition, new_values[c]).otherwise(F.col(c)).alias(c)
            if c in new_values
            else F.col(c)
            for c in base.columns
        ]
    )


def apply_deletes(base: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of ``base`` whose key is not in ``keys``."""
    return base.join(keys.select(key), key, "left_anti")


def rows_of(base: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of ``base`` whose key is in ``keys``."""
    return base.join(keys.select(key), key, "left_semi")


def _one_per_key(rows: DataFrame, key: str) -> DataFrame:
    values = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min(F.struct(*values)).alias("r"))
    return first.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def insert_ignore(base: DataFrame, rows: DataFrame, key: str = KEY) -> DataFrame:
    """``base`` plus the rows with a new key. Of several new rows with one key the smallest
    is taken."""
    new = _one_per_key(rows, key).join(base.select(key), key, "left_anti")
    return base.unionByName(new.select(*base.columns))


def upsert(base: DataFrame, rows: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """Insert the rows with a new key; put ``columns`` of the others into the stored row.

    Two incoming rows with one key are an error, as they have no defined order.
    """
    values = [c for c in base.columns if c != key]
    incoming = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*values)).alias("_new")
    )
    message = F.concat(F.lit("two rows to upsert have key "), F.col(key).cast("string"))
    single = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    incoming = incoming.filter(single).select(F.col(key).alias("_key"), "_new")
    joined = base.join(incoming, base[key] == F.col("_key"), "full")
    is_new, is_hit = F.col(key).isNull(), F.col("_key").isNotNull()
    out = []
    for c in base.columns:
        if c == key:
            out.append(F.coalesce(F.col(key), F.col("_key")).alias(key))
        elif c in columns:
            out.append(F.when(is_hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(is_new, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def duplicate_keys(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that occur more than once, and how often. Spark does not enforce keys; the
    operators here rely on them."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") > 1)


def id_range(base: DataFrame, key: str = KEY) -> tuple[int, int]:
    """Smallest and largest key, (0, 0) for an empty table. Runs a query."""
    row = base.agg(
        F.coalesce(F.min(key), F.lit(0)).alias("low"), F.coalesce(F.max(key), F.lit(0)).alias("high")
    ).head()
    return row["low"], row["high"]


def shift_ids(rows: DataFrame, by: int, key: str = KEY) -> DataFrame:
    """Rows with ``by`` added to the key."""
    return rows.withColumn(key, F.col(key) + F.lit(by).cast("long"))


def replicate(
    rows: DataFrame, copies: int, low: int, high: int, key: str = KEY, origin: str | None = None
) -> DataFrame:
    """``copies`` copies of every row, with keys above ``high`` that collide with nothing.

    Copy ``g`` gets the key plus ``g`` times the width of the key range ``low .. high``, so no
    numbering of the rows is needed. ``origin`` keeps the old key under that name.
    """
    width = high - low + 1
    numbered = rows.withColumn("_g", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    if origin is not None:
        numbered = numbered.withColumn(origin, F.col(key))
    return numbered.withColumn(key, F.col(key) + F.col("_g") * F.lit(width).cast("long")).drop("_g")


#: Hexadecimal digits of the hash that one counting pass tells apart, and rows that may be
#: sorted besides the sample itself.
_DIGITS, _SORTED = 4, 10_000


def sample_keys(rows: DataFrame, n: int, seed: str, key: str = KEY) -> DataFrame:
    """``n`` rows in a random but reproducible choice: those with the smallest hash of key
    and seed.

    Counts per hash prefix tell which prefixes hold them, digit by digit until few other rows
    are left, so only about ``n`` rows of all partitions together are sorted. Runs one small
    aggregate, more only if a prefix holds many rows.
    """
    hashed = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    prefix, before = "", 0
    while len(prefix) < 32:
        inside = rows.filter(hashed.startswith(prefix)) if prefix else rows
        counts = inside.groupBy(F.substring(hashed, len(prefix) + 1, _DIGITS).alias("p")).count()
        upto = F.sum("count").over(Window.orderBy("p"))  # at most 16**_DIGITS rows
        last = counts.withColumn("upto", upto).filter(F.col("upto") >= n - before).orderBy("p").head()
        if last is None:
            break
        prefix, before = prefix + last["p"], before + last["upto"] - last["count"]
        if last["count"] <= _SORTED:
            break
    chosen = rows.filter(F.substring(hashed, 1, len(prefix)) <= prefix) if prefix else rows
    return chosen.orderBy(hashed, key).limit(n)


def append_sample(base: DataFrame, n: int, seed: str, shift: int, key: str = KEY) -> DataFrame:
    """``base`` plus a sample of itself under new keys: the key plus ``shift``."""
    return base.unionByName(shift_ids(sample_keys(base, n, seed, key), shift, key))


def id_list(rows: DataFrame, by: str, key: str = KEY) -> DataFrame:
    """Keys per group as comma-separated text in ascending order.

    A list is built in one task, so groups must be small by construction (the copies of one
    row, say); ``id_pieces`` takes groups of any size.
    """
    ids = F.sort_array(F.collect_list(key)).cast("array<string>")
    return rows.groupBy(by).agg(F.array_join(ids, ",").alias("id_list"))


#: Ids in one piece of a list.
PIECE_IDS = 10_000


def id_pieces(rows: DataFrame, by: str, key: str = KEY, size: int = PIECE_IDS) -> DataFrame:
    """The keys of each group in ascending order as pieces of ``size`` ids: ``by``, ``piece`` from 0,
    ``id_list``. A group may hold any share of all rows.

    Rows are range-partitioned by group and key, so a large group lies in several partitions. An id's
    place is that within its partition after the group's ids in the partitions before, whose counts are
    one row for each group and partition. Repeated keys keep their number.
    """
    ranged = rows.select(by, key).repartitionByRange(by, key).withColumn("_part", F.spark_partition_id())
    placed = written(ranged, "id-ranges")  # so that both uses see the same partitions
    counts = placed.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(key))
    joined = placed.withColumn("_within", within).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    piece = F.expr(f"(_before + _within - 1) div {size}")
    ids = F.sort_array(F.collect_list(key)).cast("array<string>")
    return joined.groupBy(by, piece.alias("piece")).agg(F.array_join(ids, ",").alias("id_list"))


def parse_ids(text: Column) -> Column:
    """Comma-separated ids as an array of longs."""
    return F.split(text, ",").cast("array<bigint>")
