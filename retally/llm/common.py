"""What several operators share: tables, texts as arrays, hashing, Arrow batches."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retally.session import shared_folder

#: Texts are worked on in pieces of about so many bytes, so that memory does not follow the
#: size of an Arrow batch. One text longer than that is a piece of its own.
PIECE_BYTES = 1 << 20

_U64 = np.uint64


#: Bytes of an Arrow batch between Spark and Python, where the session has Spark's own 64 MB.
BATCH_BYTES = "8m"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables. Rows hold long texts here, so the session's Arrow batches are made
    smaller unless they were set."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in ("67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once in the shared folder: later steps read it, whatever is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder every executor reaches: a URI, or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``most`` bytes, nulls as empty texts, with the row each starts at."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    start, n = 0, len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes)))
    while start < n:
        stop = int(np.searchsorted(total, total[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, column.slice(start, stop - start)
        start = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and the offsets of its texts."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if where is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x + _U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


#: A fixed odd value for each byte, for polynomial hashes.
BYTE_VALUE = mix(np.arange(256, dtype=np.uint64), 7) | _U64(1)
#: The base of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Prefix:
    """Prefix polynomial hashes of a byte array: equal substrings have equal hashes anywhere. Hashes of
    another ``base`` and other values of bytes are independent of these."""

    def __init__(self, data: np.ndarray, base: int = BASE, values: np.ndarray = BYTE_VALUE):
        n = len(data)
        terms = values[data]
        terms *= powers(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(BASE_INVERSE if base == BASE else pow(base, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of data[start:stop], element by element."""
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


#: Bytes that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that are no letter or digit; all bytes beyond ASCII belong to letters.
_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(column: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without blanks) of all texts in order, and where each
    text's words start (one more offset than texts). With ``plain``, words are runs of letters
    and digits in lower case."""
    if plain:
        column = pc.utf8_lower(column)
    data, offsets = bytes_of(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~(_SIGNS if plain else _BLANK)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = mix(Prefix(data).of(starts, stops))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text, and where each text's runs start.
    A text of fewer words, but one at least, has one run: all its words."""
    counts = np.diff(where)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(runs)))
    total = int(out_at[-1])
    text = np.repeat(np.arange(len(counts)), runs)
    at = where[:-1][text] + (np.arange(total) - out_at[:-1][text])
    length = np.minimum(counts[text], size)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for k in range(size):
        step = out * _U64(BASE) + padded[at + k]
        out = np.where(k < length, step, out)
    return mix(out, 1), out_at


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``function`` on each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(run, schema)


#: Most runs that keys are cut into: their bounds are all that reaches the driver.
MOST_RUNS = 4096


def ordered_runs(df: DataFrame, key: str, runs: int, name: str = "run") -> DataFrame:
    """``df`` with the number of the run its key is in: runs of consecutive keys with about
    equal numbers of rows, nulls in run 0. Equal keys are in one run.

    Bounds are quantiles of the key; a row finds its run in two steps of about the square root
    of their number.
    """
    runs = min(runs, MOST_RUNS)
    number = F.col(key).cast("double")
    marks = df.select(number.alias("k")).approxQuantile("k", [i / runs for i in range(1, runs)], 0.2 / runs) if runs > 1 else []
    marks = sorted(set(marks))
    if not marks:
        return df.withColumn(name, F.lit(0))
    width = math.ceil(math.sqrt(len(marks)))
    rows = [marks[i : i + width] for i in range(0, len(marks), width)]
    listed = lambda values: "array(" + ", ".join(f"double('{v!r}')" for v in values) + ")"
    row = F.size(F.filter(F.expr(listed([r[-1] for r in rows])), lambda m: m < number))
    inside = F.get(F.expr("array(" + ", ".join(map(listed, rows)) + ")"), row)
    run = row * width + F.coalesce(F.size(F.filter(inside, lambda m: m < number)), F.lit(0))
    return df.withColumn(name, F.when(number.isNull(), 0).otherwise(run))


def unsigned(column: F.Column) -> F.Column:
    """A 64-bit hash as 16 hexadecimal digits."""
    return F.lpad(F.hex(column), 16, "0")
