"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to it if it is inside the cap around it. Directions
are words of a random product code: rotated space is cut into blocks, each block has a few random
unit vectors, and every choice of one per block is a direction. So a vector's best directions
are decoded from short lists, block by block, without a look at the others. The height of a vector's cap is
that which exactly LISTED directions of a code exceed: with one height for all, some
vectors are in thousands of caps and half of them in none, as block products add up unevenly.
Vectors are joined on filters, and pairs that meet are verified by their cosine.

Two vectors of cosine 0.98 share about nine of 16 filters a code. Codes are independent, and their
number grows with the logarithm of the filters; the chance that a pair at the very limit shares
none is below 1e-4, and less for more alike ones (``tests/llm`` measures it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retally.llm.common import free_name, mix, unsigned, written
from retally.llm.near_dup import components

#: Least cosine of a link.
SIMILAR = 0.98
#: Filters of a vector in each code. Filters of a code for each vector and each of these, so that
#: vectors meet by chance about once or less. Words of a block of a code, at most.
LISTED, SPARE, MOST_WORDS = 16, 32, 1024
#: Filters are not made finer than caps of this height, which alike vectors would no longer share.
HEIGHT = 0.7
#: Vectors of a part of a large filter; two parts meet in a task.
PART = 2000
#: Cosines closer to the limit than this are computed again, one by one.
_CLOSE = 1e-12


def cap_share(height: float, dim: int) -> float:
    """Share of the unit sphere inside a cap."""
    at = np.linspace(-1, 1, 20001)
    mass = np.maximum(1 - at * at, 1e-300) ** ((dim - 3) / 2)
    return float(mass[at >= height].sum() / mass.sum())


#: Vectors and words are rounded to multiples of 1/STEPS: their products are whole numbers that
#: double precision adds up exactly, so a vector has the same filters in whatever batch it comes.
STEPS = float(1 << 20)


class ProductCode:
    """Directions of one code in ``dim`` dimensions, about ``filters`` of them."""

    def __init__(self, dim: int, filters: float, seed: int):
        draws = np.random.default_rng([seed, dim])
        blocks = min(3 if filters <= 2**30 else 4, max(1, dim // 2))
        self.words = int(min(MOST_WORDS, max(2, math.ceil(filters ** (1 / blocks)))))
        self.turn = np.rint(STEPS * np.linalg.qr(draws.standard_normal((dim, dim)))[0])
        self.cuts = np.linspace(0, dim, blocks + 1).astype(int)
        self.lists = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            words = draws.standard_normal((self.words, b - a))
            self.lists.append(np.rint(STEPS * words / np.linalg.norm(words, axis=1)[:, None]))

    def decode(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` directions (fewer, if there are not so many) with the largest inner products
        with each vector.

        Of two lists in falling order, a sum of the places i and j is among the n largest only if
        (i + 1) (j + 1) <= n, so each block adds a few sums to those of the blocks before.
        """
        turned = np.rint(np.rint(STEPS * vectors) @ self.turn / STEPS)
        sums = names = None
        for (a, b), words in zip(zip(self.cuts, self.cuts[1:]), self.lists):
            own_sums, own = _largest(turned[:, a:b] @ words.T, n)
            if sums is None:
                sums, names = own_sums, own
                continue
            i, j = np.array([(i, j) for i in range(sums.shape[1]) for j in range(own.shape[1]) if (i + 1) * (j + 1) <= n]).T
            sums, at = _largest(sums[:, i] + own_sums[:, j], n)
            names = np.take_along_axis(names[:, i] * self.words + own[:, j], at, 1)
        return names


def _largest(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest values of each row in falling order, and their places."""
    n = min(n, values.shape[1])
    at = np.argpartition(-values, n - 1, 1)[:, :n]
    found = np.take_along_axis(values, at, 1)
    order = np.argsort(-found, 1, kind="stable")
    return np.take_along_axis(found, order, 1), np.take_along_axis(at, order, 1)


@lru_cache(8)
def codes(dim: int, vectors: int) -> tuple[ProductCode, ...]:
    """The codes for so many vectors of ``dim`` dimensions; the same ones in every task."""
    filters = min(float(SPARE) * max(vectors, 1) * LISTED, LISTED / max(cap_share(HEIGHT, dim), 1e-30))
    times = max(2, math.ceil((math.log10(max(filters, 1.0)) - 5) / 1.5))
    return tuple(ProductCode(dim, filters, seed) for seed in range(times))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, of length one."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(1)[:, None]
    return wide / np.sqrt((wide * wide).sum(1))[:, None]


def filters_of(vectors: np.ndarray, group: np.ndarray, vectors_in_all: int) -> np.ndarray:
    """Filters of each vector as 64-bit numbers that differ between groups."""
    found = []
    for k, code in enumerate(codes(vectors.shape[1], vectors_in_all)):
        names = code.decode(vectors, LISTED).astype(np.uint64)
        found.append(mix((names << np.uint64(4) | np.uint64(k)) ^ group.view(np.uint64)[:, None], 21))
    return np.sort(np.concatenate(found, 1).view(np.int64), 1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Places of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def classes(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """Equal vectors of one group as one row, written: ``node``, ``digest``, ``space`` (a hash of group and
    length), ``group``, ``vector``, ``rows``, ``least`` (the least id)."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(group).alias("group")).where(_takes_part("vector", "group"))
    own = rows.groupBy("group", "vector").agg(F.count("*").alias("rows"), F.min("id").alias("least"))
    named = own.select(
        F.monotonically_increasing_id().alias("node"),
        _digest("group", "vector").alias("digest"),
        F.xxhash64("group", F.size("vector")).alias("space"),
        F.col("group").cast("string").alias("group"),
        "vector",
        "rows",
        "least",
    )
    return written(named, "cap-classes")


def _takes_part(vector: str, group: str) -> F.Column:
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.col(group).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _digest(group: str, vector: str) -> F.Column:
    return F.unhex(F.concat(unsigned(F.xxhash64(group, vector)), unsigned(F.xxhash64(F.lit(1), group, vector))))


def _listed(own: DataFrame, total: int) -> DataFrame:
    """``filter``, ``node`` for all filters of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for rows in _by_length(part.column(2)):
                    some = part.take(pa.array(rows))
                    found = filters_of(unit(_vectors(some.column(2))), some.column(1).to_numpy(), total)
                    nodes = np.repeat(some.column(0).to_numpy(), found.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(nodes)], names=["filter", "node"])

    return written(own.select("node", "space", "vector").mapInArrow(run, "filter bigint, node bigint"), "cap-filters")


MET = "node bigint, other bigint, links bigint"


def compared(own: DataFrame) -> DataFrame:
    """What the filters find, written: rows of ``node`` and ``links``, the linked rows of other classes,
    or of two nodes that are connected. A pair is counted in the first filter both are in.

    Vectors go to the filters they share with others. A filter of more than PART vectors is dealt to
    parts, and each two of them meet in a task of their own.
    """
    total = own.count()
    listed = _listed(own, total)
    shared = listed.groupBy("filter").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    met = listed.join(shared, "filter").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # The two parts of a task: a vector meets its own part, those before it and those behind.
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
    dealt = met.select("filter", "node", "part", others).select(
        "filter", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), (F.col("part") > F.col("with")).alias("second"), "node"
    )
    full = dealt.join(own.select("node", "space", "group", "vector", "rows"), "node")
    in_runs = full.select("filter", "a", "b", "second", "node", "space", "group", "vector", "rows").repartition("filter", "a", "b")
    ordered = in_runs.sortWithinPartitions("filter", "a", "b", "second", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(names, axis=0) != 0).any(1)) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if key is not None and key != tuple(names[lo]):
                    yield from _meet(held, key, total)
                    held = []
                key = tuple(names[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _meet(held, key, total)

    return written(ordered.mapInArrow(run, MET), "cap-met")


def _meet(parts: list[pa.RecordBatch], key: tuple[int, int, int], total: int) -> Iterator[pa.RecordBatch]:
    """Links among the vectors of one task's run: of one part, or between two."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    if len(rows) < 2:
        return
    columns = {name: rows.column(name).combine_chunks() for name in rows.column_names}
    spaces = columns["group"].dictionary_encode().indices.to_numpy()
    sizes = np.diff(columns["vector"].offsets.to_numpy())
    for space in np.unique(spaces):
        for size in np.unique(sizes[spaces == space]):
            at = pa.array(np.flatnonzero((spaces == space) & (sizes == size)))
            if len(at) > 1:
                own = {name: column.take(at) for name, column in columns.items()}
                yield from _linked(own, key, total)


def _linked(own: dict[str, pa.Array], key: tuple[int, int, int], total: int) -> Iterator[pa.RecordBatch]:
    first, a, b = key
    second = own["second"].to_numpy(zero_copy_only=False)
    nodes, weights = own["node"].to_numpy(), own["rows"].to_numpy()
    wide = unit(_vectors(own["vector"]))
    cosines = wide @ wide.T
    close = np.argwhere(np.abs(cosines - SIMILAR) < _CLOSE)
    if len(close):
        cosines[close[:, 0], close[:, 1]] = (wide[close[:, 0]] * wide[close[:, 1]]).sum(1)
    links = cosines >= SIMILAR
    np.fill_diagonal(links, False)
    if a != b:
        links &= second[:, None] != second
    active = np.flatnonzero(links.any(1))
    if not len(active):
        return
    links, nodes, weights = links[np.ix_(active, active)], nodes[active], weights[active]
    _without_earlier(links, filters_of(wide[active], own["space"].to_numpy()[active], total), first)
    counts = links.astype(np.float64) @ weights.astype(np.float64)
    found = np.flatnonzero(counts)
    if not len(found):
        return
    least = _connected(links)
    far = found[least[found] != found]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([nodes[found], nodes[far]])),
            pa.array([None] * len(found) + nodes[least[far]].tolist(), pa.int64()),
            pa.array(counts[found].astype(np.int64).tolist() + [None] * len(far), pa.int64()),
        ],
        names=["node", "other", "links"],
    )


def _without_earlier(links: np.ndarray, filters: np.ndarray, first: int) -> None:
    """Takes the pairs out of ``links`` that share a filter before ``first``."""
    row, _ = np.nonzero(filters < first)
    names = filters[filters < first]
    order = np.argsort(names, kind="stable")
    row, names = row[order], names[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(names)) + 1, [len(names)]))
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo > 1:
            links[np.ix_(row[lo:hi], row[lo:hi])] = False


def _connected(links: np.ndarray) -> np.ndarray:
    """The least place each one is connected with."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(1)
        lower = np.minimum(label, near)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def linked(df: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """``df`` with ``n_links``, ``component_id`` and ``kept`` (names with underscores in front where it has them).

    Rows of one group (not null) are linked if the cosine of their vectors is SIMILAR or more.
    Vectors that are null, empty, zero or hold null or non-finite components, and those without a
    group, have no links; vectors of different lengths have none with each other. Equal vectors
    are compared once, all their rows are linked. ``component_id`` is the least id a row
    reaches (null ids do not count; null if all are), ``kept`` whether that is its own. Repeated
    rows are rows of their own; an empty table stays one.
    """
    own = classes(df, key, vector, group)
    met = compared(own)
    edges = met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    labels = components(edges)
    counts = met.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    least = own.select("node", "least").join(labels, "node").groupBy("label").agg(F.min("least").alias("reached"))
    reached = labels.join(least, "label").select("node", "reached")
    both = own.select("node", "digest", "rows", "least").join(counts, "node", "left").join(reached, "node", "left")
    # Classes without links and of one row need no look-up.
    notable = both.where("rows > 1 OR links IS NOT NULL").select(
        F.col("digest").alias("_digest"),
        (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
        F.when(F.col("reached").isNotNull(), F.col("reached")).otherwise(F.col("least")).alias("_least"),
    )
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    takes = _takes_part(f"`{vector}`", f"`{group}`")
    named = df.select(row.alias("row"), F.col(f"`{key}`").alias("id"), F.when(takes, _digest(f"`{group}`", f"`{vector}`")).alias("digest"))
    found = named.join(notable, F.col("digest") == F.col("_digest"), "left")
    names = [free_name(df, n) for n in ("n_links", "component_id", "kept")]
    component = F.when(F.col("_digest").isNotNull(), F.col("_least")).otherwise(F.col("id"))
    return found.select(
        *[F.col("row")[c].alias(c) for c in df.columns],
        F.coalesce("_links", F.lit(0)).cast("bigint").alias(names[0]),
        component.alias(names[1]),
        F.coalesce(F.col("id") == component, F.lit(False)).alias(names[2]),
    )


def link_counts(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    return linked(rows, "vec_id", "embedding", "label").select("vec_id", "n_links", "component_id", "kept")


ORACLE = f"""
WITH RECURSIVE
wide AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
used AS (
  SELECT row_number() OVER () AS row, vec_id, label, v FROM wide
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.row AS a, b.row AS b FROM used a JOIN used b ON a.label = b.label AND a.row <> b.row AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {SIMILAR}),
reach AS (
  SELECT row AS a, row AS b FROM used
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (
  SELECT r.a, min(u.vec_id) AS component_id FROM reach r JOIN used u ON u.row = r.b GROUP BY r.a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT u.vec_id, coalesce(c.n_links, 0)::BIGINT AS n_links, f.component_id, coalesce(u.vec_id = f.component_id, false) AS kept
FROM used u JOIN found f ON f.a = u.row LEFT JOIN counts c ON c.a = u.row
UNION ALL
SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM wide
WHERE label IS NULL OR v IS NULL OR len(v) = 0 OR len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0
  OR len(list_filter(v, lambda x: x <> 0)) = 0
"""
