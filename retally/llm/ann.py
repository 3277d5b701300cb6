"""Nearest neighbours by largest inner product over balanced posting lists.

Vectors get one more coordinate that gives all of them the same length; the largest inner
product is then the smallest distance. Centres of lists are fitted to a bounded sample with a
penalty on size. Every vector is put into the list of its nearest centre and, near a boundary,
into others too. A query finds near centres through a graph that each task holds in memory,
keeps those whose distance is within a ratio of the nearest one's, and is compared exactly with
the vectors of their lists. The ratio is chosen by recall: a bounded number of queries is compared
with all vectors, and the ratio grows until they find enough of their nearest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retally.llm.common import written

#: Vectors the centres are fitted to, at about so many chosen by hash: at least, and for each list.
SAMPLE, SAMPLE_OF_LIST = 20_000, 20
#: Vectors in a list, as far as the number of lists allows, and most lists (the size of what
#: each task holds). Longer lists are dealt to several blocks of BLOCK vectors.
LIST = 200
MOST_LISTS = 4096
BLOCK = 4000
#: A vector is in every list (at most REPLICAS) whose centre is within this ratio of its nearest.
REPLICAS, REPLICA_RATIO = 2, 1.02
#: A query looks into the lists whose centre is within a ratio of its nearest, at least this one,
#: and into the nearest few whatever the ratio.
PROBE_RATIO, LEAST_PROBES = 1.18, 8
#: Recall that the ratio is widened to, by so many steps, on so many queries compared with all
#: vectors. Promised is 0.9; the margin covers what other queries may differ by.
RECALL, WIDER, MEASURED = 0.95, 1.03, 200
#: Neighbours of a centre in the graph, and nearest centres that are expanded at any distance.
DEGREE, LEAST_QUEUE = 24, 16


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def fit_centres(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """``n`` centres of ``sample``; a penalty on the size of lists keeps them balanced."""
    order = np.random.default_rng(seed)
    n = min(n, len(sample))
    centres = sample[order.choice(len(sample), n, replace=False)].astype(np.float64)
    sizes, fair = np.full(n, len(sample) / n), len(sample) / n
    for k in range(rounds):
        near = np.empty(len(sample), np.int64)
        for at in range(0, len(sample), 4096):
            far = squared(sample[at : at + 4096], centres)
            near[at : at + 4096] = (far + 0.1 * far.min(1).mean() * np.minimum(sizes / fair, 4)).argmin(1)
        sizes = np.bincount(near, minlength=n).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        if k < rounds - 2:  # centres of very few vectors go halfway to vectors of full lists
            poor = np.flatnonzero(sizes < fair / 4)
            rich = np.flatnonzero(sizes[near] > 1.5 * fair)
            if len(poor) and len(rich):
                chosen = order.choice(rich, len(poor))
                centres[poor] = (centres[near[chosen]] + sample[chosen]) / 2
                sizes[poor] = fair
    return centres


class CentreGraph:
    """A graph of centres: each linked with its nearest ones, both ways, and a few at random."""

    def __init__(self, centres: np.ndarray, degree: int = DEGREE, seed: int = 1):
        self.centres, n = centres, len(centres)
        order = np.random.default_rng(seed)
        near = min(degree, n - 1)
        links = np.empty((n, near), np.int64)
        for at in range(0, n, 1024):
            far = squared(centres[at : at + 1024], centres)
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            links[at : at + 1024] = np.argsort(far, 1, kind="stable")[:, :near]
        back = np.full((n, degree), -1)
        used = np.zeros(n, int)
        for a, b in zip(np.repeat(np.arange(n), near), links.ravel()):
            if used[b] < degree:
                back[b, used[b]] = a
                used[b] += 1
        links = np.sort(np.concatenate([links, back, order.integers(0, n, (n, 4))], 1), 1)
        again = np.zeros_like(links, bool)
        again[:, 1:] = links[:, 1:] == links[:, :-1]
        self.links = np.where(again | (links < 0), np.arange(n)[:, None], links)  # to itself: none
        self.starts = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def search(self, queries: np.ndarray, ratio: float, least: int = LEAST_QUEUE) -> np.ndarray:
        """Squared distances of each query to the centres it came to (inf: to none).

        All queries move at once: each step expands the nearest centre not yet expanded, until
        that is neither among the first ``least`` nor within ``ratio`` of the nearest distance.
        """
        n, m = len(self.centres), len(queries)
        far = np.full((m, n), np.inf)
        far[:, self.starts] = squared(queries, self.centres[self.starts])
        waits = far.copy()
        active, step = np.arange(m), 0
        while len(active):
            near = waits[active].argmin(1)
            gap = waits[active, near]
            go = np.isfinite(gap) & ((step < least) | (gap <= far[active].min(1) * ratio**2))
            active, near = active[go], near[go]
            waits[active, near] = np.inf
            nexts = self.links[near]
            row, column = np.nonzero(np.isinf(far[active[:, None], nexts]))
            row, centre = active[row], nexts[row, column]
            gap = ((self.centres[centre] - queries[row]) ** 2).sum(1)
            far[row, centre] = gap
            waits[row, centre] = gap
            step += 1
        return far


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more coordinate, all of length ``norm``."""
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], 1)


def aimed(queries: np.ndarray, norm: float) -> np.ndarray:
    """Queries stretched to length ``norm``, with 0 as one more coordinate."""
    length = np.sqrt((queries * queries).sum(1))
    return np.concatenate([queries * (norm / length)[:, None], np.zeros((len(queries), 1))], 1)


def lists_of(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every vector's lists: its nearest, and others within the ratio."""
    far = np.sqrt(squared(vectors, centres))
    most = min(REPLICAS, len(centres))
    near = np.argpartition(far, most - 1, 1)[:, :most]
    gaps = np.take_along_axis(far, near, 1)
    keep = gaps <= np.maximum(gaps.min(1) * REPLICA_RATIO, gaps.min(1))[:, None]
    rows, which = np.nonzero(keep)
    return rows, near[rows, which]


def probes_of(queries: np.ndarray, graph: CentreGraph, ratio: float = PROBE_RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists each query looks into."""
    far = graph.search(queries, ratio)
    nearest = np.sort(far, 1)[:, : LEAST_PROBES]
    limit = np.maximum(nearest[:, 0] * ratio**2, nearest[:, -1])
    return np.nonzero((far <= limit[:, None]) & np.isfinite(far))


def recall_of(queries: np.ndarray, near: list[np.ndarray], graph: CentreGraph, norm: float, ratio: float) -> float:
    """Share of the nearest vectors (``near``, for each query) that are in a list it looks into."""
    row, where = probes_of(aimed(queries, norm), graph, ratio)
    looks = np.zeros((len(queries), len(graph.centres)), bool)
    looks[row, where] = True
    of = np.repeat(np.arange(len(near)), [len(x) for x in near])
    if not len(of):
        return 1.0
    vector, where = lists_of(lifted(np.concatenate(near), norm), graph.centres)
    found = np.zeros(len(of), bool)
    np.logical_or.at(found, vector, looks[of[vector], where])
    return float(found.mean())


def wide_enough(queries: np.ndarray, near: list[np.ndarray], centres: np.ndarray, norm: float) -> float:
    """The least ratio from PROBE_RATIO on, in steps, with a recall of RECALL for ``queries``; at
    worst the one that leads to all lists."""
    graph, ratio = CentreGraph(centres), PROBE_RATIO
    while recall_of(queries, near, graph, norm, ratio) < RECALL:
        ratio *= WIDER
        if ratio > 1e3:
            return float("inf")
    return ratio


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part, each once.

    Left out are null ids and vectors that are null, zero, hold null or non-finite components,
    or are not as long as most (of two lengths equally frequent the smaller counts).
    """
    limit = F.lit(float("inf"))
    kept = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where(
        F.col("id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
        & F.exists("vector", lambda x: x != 0)
    )
    usual = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return kept
    return kept.where(F.size("vector") == usual["n"]).groupBy("id", "vector").agg(F.lit(1).alias("one")).drop("one")


def equal_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per different vector with its k + 1 smallest ids: of equal vectors, which are
    equally near to anything, no others can be among k results."""
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= k + 1)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit_index(vectors: DataFrame, norm: float, n_lists: int, n_vectors: int) -> np.ndarray:
    """Centres of the lists, fitted in one task to about SAMPLE vectors chosen by hash, more for
    many lists (SAMPLE_OF_LIST each, and MOST_LISTS at most)."""
    share = min(1.0, max(SAMPLE, SAMPLE_OF_LIST * n_lists) / max(n_vectors, 1))
    chance = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(chance < share).select("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(batch.column(0)) for batch in batches if batch.num_rows]
        if parts:
            rows = np.concatenate(parts)
            rows = rows[np.lexsort(rows.T[:3])]  # the order rows arrive in does not matter
            centres = fit_centres(lifted(rows, norm), n_lists)
            yield pa.RecordBatch.from_arrays([pa.array([centres.tobytes()], pa.binary())], names=["centres"])

    found = sample.repartition(1).mapInArrow(run, "centres binary").collect()
    if not found:  # chance left the sample of a tiny table empty
        vector = np.array(vectors.select("vector").first()[0], float)[None]
        return lifted(vector, norm)
    width = len(vectors.select("vector").first()[0]) + 1
    return np.frombuffer(bytes(found[0][0]), np.float64).reshape(-1, width)


def exact_neighbours(vectors: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """The k vectors with the largest inner products for each of a few queries, by comparison with
    all ``vectors``, but for the query's own. Each task gives k for each query."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        m, width = asked.shape
        best, held = np.full((m, k), -np.inf), np.zeros((m, k, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = _matrix(batch.column(0).slice(at, 4096))
                scores = asked @ part.T
                top = np.argpartition(-scores, min(k, len(part) - 1), 1)[:, : k + 1]
                own = (part[top] == asked[:, None, :]).all(2)
                some = np.where(own, -np.inf, np.take_along_axis(scores, top, 1))
                both, rows = np.concatenate([best, some], 1), np.concatenate([held, part[top]], 1)
                keep = np.argsort(-both, 1, kind="stable")[:, :k]
                best, held = np.take_along_axis(both, keep, 1), np.take_along_axis(rows, keep[:, :, None], 1)
        q, j = np.nonzero(np.isfinite(best))
        if len(q):
            columns = [pa.array(q, pa.int32()), pa.array(best[q, j]), pa.array([x.tobytes() for x in held[q, j]], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "vector"])

    found = vectors.select("vector").mapInArrow(run, "query int, score double, vector binary")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vector"))
    near: list[list[bytes]] = [[] for _ in queries]
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "vector").collect():  # MEASURED * k rows
        near[r["query"]].append(bytes(r["vector"]))
    return [np.frombuffer(b"".join(x), np.float64).reshape(-1, queries.shape[1]) for x in near]


def measured_ratio(vectors: DataFrame, asked: DataFrame, centres: np.ndarray, norm: float, k: int) -> float:
    """The ratio with which at most MEASURED of ``asked`` (``query``, ``vector``), chosen by hash, find
    enough of their k nearest among all ``vectors``."""
    if len(centres) <= LEAST_PROBES:
        return PROBE_RATIO
    chosen = asked.select("query", "vector").orderBy(F.xxhash64("query"), "vector").limit(MEASURED).collect()
    if not chosen:
        return PROBE_RATIO
    queries = np.array([r["vector"] for r in chosen], np.float64)
    return wide_enough(queries, exact_neighbours(vectors, queries, k), centres, norm)


POSTINGS = "list int, ids array<bigint>, vector binary"


def nearest(df: DataFrame, key: str, vector: str, is_query: F.Column, k: int) -> DataFrame:
    """The k nearest other rows found for each query: ``query_id``, ``rank``, ``id``, ``score``.

    ``is_query`` is a condition on the column ``id``. Scores are inner products in double
    precision; ties go to the smaller id. With fewer than k candidates all are given.
    """
    spark = df.sparkSession
    rows = written(usable(df, key, vector), "ann-rows")
    vectors = written(equal_vectors(rows, k), "ann-vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, norm = vectors.agg(F.count("*"), F.sqrt(F.max(square))).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    if not n:
        return empty
    n_lists = max(1, min(MOST_LISTS, n // LIST))
    centres = fit_index(vectors, norm, n_lists, n)
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_LISTS rows
    # Queries with equal vectors are one; 64 bits of hash tell different vectors apart.
    asked = rows.where(is_query).select("id", "vector", F.xxhash64("vector").alias("query"))
    different = asked.groupBy("query", "vector").agg(F.count("*").alias("n")).select("query", "vector")
    ratio = measured_ratio(vectors, different, centres, norm, k)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                matrix = _matrix(part.column(0))
                row, where = lists_of(lifted(matrix, norm), shared.value)
                data = [x.tobytes() for x in matrix]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), part.column(1).take(pa.array(row)), pa.array([data[i] for i in row], pa.binary())],
                    names=["list", "ids", "vector"],
                )

    postings = written(vectors.select("vector", "ids").mapInArrow(post, POSTINGS), "ann-postings")
    sizes = postings.groupBy("list").count().where(F.col("count") > BLOCK).collect()  # at most MOST_LISTS
    blocks = np.ones(len(centres), int)
    for r in sizes:
        blocks[r["list"]] = -(-r["count"] // BLOCK)
    dealt = spark.sparkContext.broadcast(blocks)

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(0).to_numpy()
            first = pa.array([ids[0] for ids in batch.column(1).to_pylist()]).to_numpy()
            block = (first // 7 + first) % dealt.value[where]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(block, pa.int32()), pa.array(np.zeros(len(where)), pa.int8()), pa.array(np.zeros(len(where)), pa.int64()), batch.column(1), batch.column(2)],
                names=["list", "block", "kind", "query", "ids", "vector"],
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentreGraph(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                matrix = _matrix(part.column(1))
                row, where = probes_of(aimed(matrix, norm), graph, ratio)
                times = dealt.value[where]
                row, where = np.repeat(row, times), np.repeat(where, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                data = [x.tobytes() for x in matrix]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(where, pa.int32()),
                        pa.array(block, pa.int32()),
                        pa.array(np.ones(len(row)), pa.int8()),
                        part.column(0).take(pa.array(row)),
                        pa.nulls(len(row), pa.list_(pa.int64())),
                        pa.array([data[i] for i in row], pa.binary()),
                    ],
                    names=["list", "block", "kind", "query", "ids", "vector"],
                )

    sides = "list int, block int, kind tinyint, query bigint, ids array<bigint>, vector binary"
    both = postings.mapInArrow(block_of, sides).unionByName(different.mapInArrow(probe, sides))
    met = both.repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    found = met.mapInArrow(lambda b: _meet(b, k + 1), "query bigint, ids binary, scores binary")
    best = found.repartition("query").sortWithinPartitions("query").mapInArrow(lambda b: _best(b, k + 1), "query bigint, near array<struct<id:bigint,score:double>>")
    own = asked.select("id", "query").join(best, "query")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "found")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("id"), F.col("found.score").alias("score")
    )


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Scores of queries with the vectors of their list block, which come before them: the k
    best ids of each query. Holds one block."""
    key, parts, held = None, [], None
    for batch in batches:
        where = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
        kinds = batch.column(2).to_numpy()
        cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
            if where[a] != key:
                key, parts, held = where[a], [], None
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                parts.append(part)
                continue
            if held is None and parts:
                ids = pa.concat_arrays([p.column(4) for p in parts])
                of = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
                held = (_vectors(pa.concat_arrays([p.column(5) for p in parts]))[of], ids.flatten().to_numpy())
                parts = []
            if held is None:
                continue  # no vector is in this block
            matrix, ids = held
            for at in range(0, b - a, 512):
                asked = part.slice(at, 512)
                names, scores = _best_of(_vectors(asked.column(5)), matrix, ids, k)
                columns = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (names, scores)]
                yield pa.RecordBatch.from_arrays([asked.column(3), *columns], names=["query", "ids", "scores"])


def _best_of(queries: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids of each query and their scores, best first, ties by id."""
    rough = queries @ matrix.T
    n = len(ids)
    some = min(k + 8, n)
    top = np.argpartition(-rough, some - 1, 1)[:, :some]
    if some < n:
        # Scores of a product may differ in their last bits from those of a row's own sum.
        limit = np.partition(np.take_along_axis(rough, top, 1), some - k, 1)[:, some - k]
        crowded = (rough >= (limit - 1e-9 * (1 + np.abs(limit)))[:, None]).sum(1)
        some = min(n, max(some, int(crowded.max(initial=0))))
        top = np.argpartition(-rough, some - 1, 1)[:, :some]
    top = np.take_along_axis(top, np.argsort(ids[top], 1, kind="stable"), 1)
    scores = inner(matrix[top], queries[:, None, :])
    order = np.argsort(-scores, 1, kind="stable")[:, :k]
    return np.take_along_axis(ids[top], order, 1), np.take_along_axis(scores, order, 1)


def inner(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever it is done."""
    return np.ascontiguousarray(matrix * query).sum(-1)


def _vectors(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of what was found for each query in all its lists; an id counts once."""
    kind = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())]))
    key, names, values = None, [], []

    def close() -> tuple[int, list[dict]]:
        ids, scores = np.frombuffer(b"".join(names), np.int64), np.frombuffer(b"".join(values), np.float64)
        order = np.lexsort((ids, -scores))
        pairs = dict(zip(zip(ids[order].tolist(), scores[order].tolist()), order))  # replicas are equal
        return key, [{"id": i, "score": s} for i, s in list(pairs)[:k]]

    for batch in batches:
        out = []
        for query, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
            if query != key:
                if names:
                    out.append(close())
                key, names, values = query, [], []
            names.append(ids)
            values.append(scores)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind)], names=["query", "near"])
    if names:
        query, near = close()
        yield pa.RecordBatch.from_arrays([pa.array([query], pa.int64()), pa.array([near], kind)], names=["query", "near"])


#: Of every how many ids one is a query, and results for each.
EVERY, NEAREST = 20, 20


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """The nearest vectors of the rows whose id is divisible by EVERY, among all other rows."""
    found = nearest(embeddings, "vec_id", "embedding", F.col("id") % EVERY == 0, NEAREST)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
