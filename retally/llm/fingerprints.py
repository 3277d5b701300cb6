"""Document fingerprints: the k smallest hashes of a text's shingles.

The k smallest of all hashes of a union are among the k smallest of its parts, so fingerprints
merge. From two of them follow estimates of resemblance (Jaccard similarity), containment and
the number of distinct shingles; they are exact while there are at most k of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retally.llm.common import free_name, ordered_runs, shingle_hashes, text_pieces, word_hashes

#: Hashes kept, and words in a shingle.
K = 128
SHINGLE = 5


def sketches(texts: pa.Array, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending.

    Texts of fewer words than ``size`` have one shingle, all their words; texts without words
    have none.
    """
    hashes, where = shingle_hashes(*word_hashes(texts), size)
    out = []
    for a, b in zip(where[:-1].tolist(), where[1:].tolist()):
        part = hashes[a:b]
        most = 2 * k
        while len(part) > most:  # repeated hashes may hide smaller ones; then look further
            low = np.unique(np.partition(part, most)[: most + 1])
            if len(low) >= k:
                part = low
                break
            most *= 2
        out.append(np.unique(part)[:k])
    return out


def merged(sketch: np.ndarray, other: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets of shingles."""
    return np.union1d(sketch, other)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two texts without words, 0 for one."""
    union = merged(a, b, k)
    if not len(union):
        return 1.0
    in_both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    return float(in_both.sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 if ``a`` has none."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merged(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def from_text(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u8")


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, size: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of each text (null: as an empty text). Other columns stay."""
    out = free_name(df, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            made = [to_text(s) for _, piece in text_pieces(column) for s in sketches(piece, k, size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def merge(df: DataFrame, by: list[str], name: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per value of ``by``, of all its texts together.

    Partitions are merged before the shuffle, so no group is ever gathered: what meets per
    value is at most one fingerprint of each partition, merged two at a time.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([*(T.StructField(c, types[c]) for c in by), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, value in zip(*columns):
                key, sketch = tuple(key), from_text(value)
                held[key] = merged(held[key], sketch, k) if key in held else sketch[:k]
            if len(held) > 50_000:  # pass on what there is; it is merged after the shuffle
                yield _rows(held, schema)
                held = {}
        if held:
            yield _rows(held, schema)

    def _rows(held: dict, schema: T.StructType) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = [*zip(*held), [to_text(s) for s in held.values()]]
        shape = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sketch = None, None
        done: dict[tuple, np.ndarray] = {}
        for batch in batches:  # sorted: a value's fingerprints follow one another
            for *now, value in zip(*[c.to_pylist() for c in batch.columns]):
                now = tuple(now)
                if now != key:
                    if key is not None:
                        done[key] = sketch
                    key, sketch = now, from_text(value)
                else:
                    sketch = merged(sketch, from_text(value), k)
                if len(done) >= 10_000:
                    yield _rows(done, schema)
                    done = {}
        if key is not None:
            done[key] = sketch
        if done:
            yield _rows(done, schema)

    chosen = df.select(*by, name)
    return chosen.mapInArrow(run, schema).repartition(*by).sortWithinPartitions(*by).mapInArrow(whole, schema)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document its text, its successor's text by ascending ``doc_id``, and its edited text:
    the last half of its code points replaced by as many (or all) of the successor's first.

    After the last document comes the first. Null ids come first, equal ids are ordered by
    text; null texts are empty. A lone document is its own successor.

    Documents are dealt to runs of consecutive ids. The first document of each run is sent to
    the run before it too, so each text is shuffled once and no run needs another.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ordered_runs(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", 8 * parts)
    # Each run's first id (one row per run: a bounded number), and the run before it, around.
    firsts = sorted(
        rows.groupBy("run").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first")).collect(),
        key=lambda r: r["run"],
    )
    if not firsts:
        return spark.createDataFrame([], "doc_id bigint, text string, following string, edited string")
    heads = spark.createDataFrame(
        [(r["run"], r["first"]["doc_id"], firsts[i - 1]["run"]) for i, r in enumerate(firsts)], "run int, doc_id bigint, back int"
    )
    peeks = rows.join(F.broadcast(heads), (rows["run"] == heads["run"]) & rows["doc_id"].eqNullSafe(heads["doc_id"]))
    peeks = peeks.select(heads["back"].alias("run"), F.lit(True).alias("peek"), rows["doc_id"], rows["text"])
    dealt = rows.select("run", F.lit(False).alias("peek"), "doc_id", "text").unionByName(peeks)
    dealt = dealt.repartition(parts, "run").sortWithinPartitions("run", "peek", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False  # a document that waits for its successor; whether its run is over
        for batch in batches:
            for start, piece in text_pieces(batch.column(3)):
                rest, out = batch.slice(start, len(piece)), []
                for number, peek, doc_id, text in zip(*[c.to_pylist() for c in rest.columns]):
                    if held and held[0] == number and not done:
                        half = len(held[2]) // 2
                        out.append((held[1], held[2], text, held[2][: len(held[2]) - half] + text[:half]))
                    held, done = (number, doc_id, text), peek
                if out:
                    doc_ids, *texts = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), *(pa.array(t, pa.string()) for t in texts)],
                        names=["doc_id", "text", "following", "edited"],
                    )

    return dealt.mapInArrow(run, "doc_id bigint, text string, following string, edited string")


def compared(pairs: DataFrame, k: int = K) -> DataFrame:
    """Per document: its fingerprint, its edited text's, and how alike its own is to that and to
    its successor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, edited in text_pieces(batch.column(3)):
                n = len(edited)
                own, nexts = (batch.column(i).slice(start, n) for i in (1, 2))
                a, b, c = (sketches(x, k) for x in (own, nexts, edited))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, n),
                        own,
                        edited,
                        pa.array([to_text(x) for x in a], pa.string()),
                        pa.array([to_text(x) for x in c], pa.string()),
                        pa.array([resemblance(x, y, k) for x, y in zip(a, c)], pa.float64()),
                        pa.array([resemblance(x, y, k) for x, y in zip(a, b)], pa.float64()),
                        pa.array([distinct(x, k) for x in a], pa.float64()),
                        pa.array([containment(x, y, k) for x, y in zip(a, c)], pa.float64()),
                    ],
                    names=["doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "in_edited"],
                )

    return pairs.mapInArrow(
        run,
        "doc_id bigint, text string, edited string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, n_shingles double, in_edited double",
    )


def digests(docs: DataFrame) -> DataFrame:
    return compared(edited_pairs(docs)).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "n_shingles",
        "in_edited",
    )
