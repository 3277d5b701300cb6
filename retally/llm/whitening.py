"""Whitening of vectors through the singular values of a bidiagonal matrix.

Centred rows are reduced by QR block by block, and the triangular factors of the blocks by QR
again, in a tree, until one factor is left: its singular values are those of all rows, and it
has no more numbers than the square of their length. Householder reflections make it bidiagonal,
the qd algorithm with shifts (dqds) finds its singular values with high relative accuracy, and
twisted factorisations of the shifted tridiagonal matrix give the directions: a factorisation
from the top and one from the bottom meet where the twist is smallest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retally.llm.common import written

#: Rows of a block whose factor is computed at once, and factors that meet in one task of the tree.
BLOCK, FAN_IN = 8192, 32
_EPS = float(np.finfo(np.float64).eps)


# --- one small matrix -------------------------------------------------------------------------


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of U' A V for a square matrix A by Householder reflections, and V."""
    a = np.array(matrix, np.float64)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        if not np.any(x[1:]):
            return None
        v = x / np.abs(x).max()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1 :]) if k < n - 2 else None
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _qd_pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One qd transform with a shift; None if the shift is above the least eigenvalue."""
    new_q, new_e = [], []
    d = q[0] - shift
    for k in range(len(e)):
        s = d + e[k]
        if d < 0 or s <= 0:
            if shift:
                return None
            s = max(s, 1e-300)
        ratio = q[k + 1] / s
        new_q.append(s)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e


def _shift(q: list[float], e: list[float]) -> float:
    """Least eigenvalue of the last two-by-two block, an upper bound of that of the whole."""
    trace, root = q[-2] + e[-1] + q[-1], math.hypot(0.5 * (q[-2] + e[-1] - q[-1]), math.sqrt(q[-1] * e[-1]))
    large = 0.5 * trace + root
    return q[-2] * (q[-1] / large) if large else 0.0


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal matrix with this diagonal and superdiagonal, largest first.

    The arrays hold squares, all positive, so nothing cancels while shifts stay below the least
    eigenvalue; one that does not is tried again smaller. Values are taken off at the end, and
    entries above the diagonal that no longer count split the rest.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    parts = [([float(x) ** 2 for x in diagonal / scale], [float(x) ** 2 for x in above / scale], 0.0)]
    while parts:
        q, e, sigma = parts.pop()
        turns = 0
        while q:
            turns += 1
            if turns > 100 * (len(q) + 20):
                raise ArithmeticError("the qd algorithm does not converge")
            if len(q) == 1:
                found.append(sigma + q.pop())
            elif e[-1] <= _EPS**2 * (sigma + q[-1]):
                found.append(sigma + q.pop())
                e.pop()
            elif len(q) == 2:
                small = _shift(q, e)
                found.extend((sigma + small, sigma + (q[0] + e[0] + q[1] - small)))
                break
            else:
                cut = next((k for k in range(len(e) - 1) if e[k] <= _EPS**2 * (sigma + q[k + 1])), None)
                if cut is not None:
                    parts.append((q[: cut + 1], e[:cut], sigma))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                    continue
                if q[-1] > 1.5 * q[0]:  # small values converge at the end
                    q, e = q[::-1], e[::-1]
                shift = _shift(q, e) * (1 - 8 * _EPS)
                while (made := _qd_pass(q, e, shift)) is None:
                    shift = shift / 2 if shift > 1e-8 * q[-1] else 0.0
                (q, e), sigma = made, sigma + shift
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def twisted(q: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue, from the squares of B's diagonal and superdiagonal:
    the stationary and the progressive qd transform of B'B - value, joined at the least twist."""
    n = len(q)
    off = np.sqrt(q[:-1] * e)
    least = _EPS**2 * (np.abs(q).max() + np.abs(e).max(initial=0.0))

    def pivot(x: float) -> float:
        return x if abs(x) > least else math.copysign(least, x)

    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for k in range(n - 1):
        d = pivot(s[k] + q[k])
        down[k] = off[k] / d
        s[k + 1] = s[k] * (e[k] / d) - value
    p[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        d = pivot(e[k] + p[k + 1])
        up[k] = off[k] / d
        p[k] = p[k + 1] * (q[k] / d) - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -up[k] * z[k]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def singular_directions(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest singular values of a square matrix and their right singular vectors, as
    columns. Values that are zero within rounding are left out."""
    diagonal, above, right = bidiagonal(matrix)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, above = diagonal / scale, above / scale
    # Blocks that nothing links have values and vectors of their own, equal ones too.
    cuts = [0, *(np.flatnonzero(np.abs(above) <= _EPS) + 1).tolist(), len(diagonal)]
    pairs = []
    for lo, hi in zip(cuts, cuts[1:]):
        values = dqds(diagonal[lo:hi], above[lo : hi - 1])
        q, e = diagonal[lo:hi] ** 2, above[lo : hi - 1] ** 2
        links = diagonal[lo : hi - 1] * above[lo : hi - 1]
        signs = np.cumprod(np.concatenate(([1.0], np.where(links < 0, -1.0, 1.0))))  # squares have lost them
        own: list[np.ndarray] = []
        for k, value in enumerate(values):
            if value <= _EPS * len(diagonal):
                break
            z = twisted(q, e, value**2) if hi - lo > 1 else np.ones(1)
            near = [own[j] for j in range(k - 1, -1, -1) if values[j] - value <= 1e-3 * values[0]]
            own.append(_apart(z, near, q, e, value**2))
            pairs.append((value, lo, signs * own[-1]))
    pairs.sort(key=lambda pair: -pair[0])
    vectors = np.zeros((len(diagonal), min(most, len(pairs))))
    for k, (_, lo, z) in enumerate(pairs[:most]):
        vectors[lo : lo + len(z), k] = z
    return scale * np.array([pair[0] for pair in pairs[:most]]), right @ vectors


def _apart(z: np.ndarray, near: list[np.ndarray], q: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """``z`` without its parts along the vectors of close values. Where nothing is left, vectors
    are tried that inverse iteration leads to from other starts."""
    if not near:
        return z
    basis = np.array(near)
    draws = np.random.default_rng(len(near))
    n = len(q)
    shifted = np.diag(q + np.concatenate(([0.0], e)) - value * (1 + 4 * _EPS))
    off = np.sqrt(q[:-1] * e)
    shifted[np.arange(n - 1), np.arange(1, n)] = shifted[np.arange(1, n), np.arange(n - 1)] = off
    for _ in range(8):
        left = z - basis.T @ (basis @ z)
        size = np.linalg.norm(left)
        if size > 0.1:
            left = left - basis.T @ (basis @ left)
            return left / np.linalg.norm(left)
        z = draws.standard_normal(n)
        for _ in range(3):
            z = z - basis.T @ (basis @ z)
            z = np.linalg.solve(shifted, z)
            z /= np.linalg.norm(z)
    raise ArithmeticError("no direction is left for a singular value")


# --- all rows ---------------------------------------------------------------------------------


class Model(NamedTuple):
    """What whitens: ``components`` has one direction a column, of falling ``variances``."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


#: Scaled entries, x = floor(SCALE * c) + OFFSET; |SCALE * c| counts as MOST where it is larger.
SCALE, OFFSET, MOST = 64, 1_000_000, float(1 << 46)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part, as often as they stand there.

    Left out are vectors that are null or empty, hold null or non-finite entries, or are not as
    long as most (of two lengths equally frequent the smaller counts). Null ids take part.
    """
    limit = F.lit(float("inf"))
    kept = df.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where(
        (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    )
    usual = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept if usual is None else kept.where(F.size("vector") == usual["n"])


def scaled(column: pa.Array) -> np.ndarray:
    """The whole numbers x of the vectors of a batch, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(SCALE * flat), -MOST, MOST).astype(np.int64) + OFFSET
    return whole.reshape(len(column), -1)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where they suffice, else as Python's whole numbers."""
    if max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums))) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, each entry rounded once."""
    return (_offsets(x, n, sums) / n).astype(np.float64)


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of x by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = scaled(batch.column(0)).sum(0).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([sums], pa.list_(pa.int64()))], names=["n", "sums"])

    part = rows.select("vector").mapInArrow(run, "n bigint, sums array<bigint>")
    each = part.select("n", F.posexplode("sums").alias("at", "part"))
    found = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("sum")).orderBy("at").collect()
    return (found[0]["n"] if found else 0), [int(r["sum"]) for r in found]


def _joined(rows: DataFrame, of_task: Callable, together: Callable, name: str) -> bytes | None:
    """``of_task`` makes one piece of bytes of the batches of each task, ``together`` one of several;
    pieces meet FAN_IN at a time in a tree until one is left. None without rows."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = of_task(batch for batch in batches if batch.num_rows)
        if piece is not None:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([piece], pa.binary())], names=["at", "piece"])

    def node(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        in_order = group.sort_by("at").column("piece").to_pylist()
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "piece": pa.array([together(in_order)], pa.binary())})

    schema = "at bigint, piece binary"
    level = written(rows.mapInArrow(leaf, schema), name)
    while (last := level.agg(F.max("at")).first()[0]) is not None:
        if last == 0:
            return bytes(level.select("piece").first()[0])
        parent = F.expr(f"at div {FAN_IN}").alias("parent")
        level = written(level.groupBy(parent).applyInArrow(node, schema), name)
    return None


def _factor(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The triangular factor of the rows of all blocks, square."""
    factor = np.zeros((0, width))
    for block in blocks:
        factor = np.linalg.qr(np.concatenate([factor, block]), mode="r")
    return np.concatenate([factor, np.zeros((width - len(factor), width))])


def fit(rows: DataFrame, most: int) -> Model | None:
    """The model of ``rows`` (``vector``), None without rows. At most ``most`` directions, and no more
    than the rank of the centred rows. The driver gets one factor: the square of the length of
    a vector in numbers; a task of the tree holds FAN_IN of them."""
    n, sums = _totals(rows)
    if not n:
        return None
    width = len(sums)

    def of_task(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        blocks = (
            centred(scaled(batch.column(0).slice(at, BLOCK)), n, sums) for batch in batches for at in range(0, batch.num_rows, BLOCK)
        )
        return _factor(blocks, width).tobytes()

    def together(pieces: list[bytes]) -> bytes:
        return _factor((np.frombuffer(p).reshape(width, width) for p in pieces), width).tobytes()

    found = _joined(rows.select("vector"), of_task, together, "whitening-factor")
    factor = np.frombuffer(found).reshape(width, width)
    values, directions = singular_directions(factor, most)
    return Model(n, sums, directions, values**2 / n, float((factor * factor).sum() / n))


def _whitened(x: np.ndarray, model: Model) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.components / np.sqrt(model.variances))


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest entry, by size, of the covariance of the whitened rows less the identity."""
    k = len(model.variances)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def merged(parts: Iterator[np.ndarray]) -> np.ndarray:
        """Counts, means and centred products of several parts, as one array of k + 2 rows."""
        total = np.zeros((k + 2, k))
        for part in parts:
            have, more = total[0, 0], part[0, 0]
            gap = part[1] - total[1]
            total[2:] += part[2:] + np.outer(gap, gap) * (have * more / (have + more))
            total[1] += gap * (more / (have + more))
            total[0] = have + more
        return total

    def of_block(block: np.ndarray) -> np.ndarray:
        mean = block.mean(0)
        return np.concatenate([np.full((1, k), float(len(block))), mean[None], (block - mean).T @ (block - mean)])

    def of_task(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        parts = [of_block(_whitened(scaled(batch.column(0)), shared.value)) for batch in batches]
        return merged(iter(parts)).tobytes() if parts else None

    def together(pieces: list[bytes]) -> bytes:
        return merged(np.frombuffer(p).reshape(k + 2, k) for p in pieces).tobytes()

    total = np.frombuffer(_joined(rows.select("vector"), of_task, together, "whitening-error")).reshape(k + 2, k)
    return float(np.abs(total[2:] / total[0, 0] - np.eye(k)).max())


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """``id``, ``deviation`` (sum over dimensions of (n x - S)^2, null beyond 64 bits) and ``whitened``, one
    number per component, of every one of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = scaled(part.column(1))
                away = _offsets(x, shared.value.n, shared.value.sums)
                if away.dtype != object and float(np.abs(away).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
                    away = away.astype(object)
                sizes = (away * away).sum(1).tolist()
                made = _whitened(x, shared.value)
                offsets = pa.array(np.arange(len(x) + 1) * made.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))
                fits = pa.array([s if s < 1 << 63 else None for s in sizes], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fits, lists], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")


#: Components that the query returns, at most.
COMPONENTS = 32
DIGESTS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def components_of(embeddings: DataFrame) -> DataFrame:
    """Per row that takes part and component: what the row is whitened to, and how much the component
    explains. Rows that are all equal, or a single one, have no component; repeated rows count
    and are returned as often as they stand there, null ids too."""
    spark = embeddings.sparkSession
    rows = usable(embeddings, "vec_id", "embedding").select(F.col("id").cast("bigint").alias("id"), "vector")
    model = fit(rows, COMPONENTS)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], DIGESTS)
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    each = apply(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
