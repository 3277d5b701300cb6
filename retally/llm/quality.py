"""Quality classifier: a support vector machine over n-gram indicators scaled by their
naive Bayes log-count ratios.

An indicator says whether an n-gram occurs in a text: an n-gram of its bytes, or of the signs
that say for each word whether it repeats the word before. Its log-count ratio compares how
often texts of either label have it. A linear model with hinge loss is fitted to the
scaled indicators by dual coordinate descent, and its margins are turned into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from retally.llm.common import bytes_of, free_name, text_pieces, word_hashes

#: Indicators: byte n-grams of these lengths, each dealt to one of 2**BITS by its hash.
LENGTHS = (2, 3, 4)
BITS = 18
#: And n-grams of up to so many signs of repeated words, each with an indicator of its own.
SIGNS = 4
WIDTH = (1 << BITS) + (2 << SIGNS)
#: The model is fitted on about so many labelled documents of each label, chosen by hash.
SAMPLE_PER_LABEL = 3000
#: Bytes of a text that count for one entry of the bitmap: pieces of this size are looked at in
#: turn, so a text of any length is taken whole in bounded memory.
CHUNK = 1 << 20

SMOOTHING, PENALTY, ROUNDS = 1.0, 1.0, 20


class Indicators:
    """Which n-grams a text has, through a bitmap that is wiped after each text."""

    def __init__(self):
        self.seen = np.zeros(WIDTH, bool)

    def of_texts(self, texts: pa.Array) -> list[np.ndarray]:
        data, at = bytes_of(texts)
        words, where = word_hashes(texts)
        cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), where[:-1].tolist(), where[1:].tolist()))
        return [self.of(data[a:b], words[c:d]) for a, b, c, d in cuts]

    def of(self, data: np.ndarray, words: np.ndarray) -> np.ndarray:
        sign = (words[1:] == words[:-1]).astype(np.int64)
        code = np.ones(len(sign), np.int64)
        for n in range(1, SIGNS + 1):
            code = 2 * code[: len(sign) - n + 1] + sign[n - 1 :] if len(sign) >= n else code[:0]
            self.seen[(1 << BITS) + code] = True
        longest = max(LENGTHS)
        for at in range(0, max(len(data), 1), CHUNK):
            part = data[at : at + CHUNK + longest - 1].astype(np.uint32)
            code = part.copy()
            for n in range(2, longest + 1):
                code = code[:-1] | (part[n - 1 :] << np.uint32(8 * (n - 1))) if len(code) else code
                if n in LENGTHS:
                    self.seen[(code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 1, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled weights of the indicators, squares of their ratios, and (slope, offset) of the
    probability. ``weights``: how many documents each row stands for."""
    good = labels == 1
    if not len(rows) or good.all() or not good.any():  # nothing to tell apart
        share = (weights[good].sum() + 1) / (weights.sum() + 2)
        return np.zeros(WIDTH), np.zeros(WIDTH), np.array([0.0, np.log(share / (1 - share)), 0.0])
    counts = np.zeros((2, WIDTH))
    for row, label in zip(rows, labels):
        counts[label, row] += 1
    shares = (counts + SMOOTHING) / (np.array([[(~good).sum()], [good.sum()]]) + 2 * SMOOTHING)
    ratio = np.log(shares[1] / shares[0])
    values = [ratio[row] for row in rows]
    values = [v / max(np.sqrt(v @ v), 1e-12) for v in values]
    order = np.random.default_rng(seed)
    # A fifth of the rows is kept back for the probabilities.
    back = order.permutation(len(rows)) % 5 == 0
    sign = np.where(good, 1.0, -1.0)

    def descend(train: np.ndarray) -> tuple[np.ndarray, float]:
        w, bias, dual = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
        cost = PENALTY * np.where(good, len(rows) / (2 * good.sum()), len(rows) / (2 * (~good).sum()))
        for _ in range(rounds):
            for i in order.permutation(train):
                row, x = rows[i], values[i]
                slope = sign[i] * (w[row] @ x + bias) - 1.0
                new = min(max(dual[i] - slope / 2.0, 0.0), cost[i])  # the norm of (x, 1) is 2
                if new != dual[i]:
                    step = (new - dual[i]) * sign[i]
                    w[row] += step * x
                    bias += step
                    dual[i] = new
        return w, bias

    w, bias = descend(np.flatnonzero(~back))
    margins = np.array([w[rows[i]] @ values[i] + bias for i in np.flatnonzero(back)])
    slope, offset = _probability(margins, good[back], weights[back])
    w, bias = descend(np.arange(len(rows)))
    return w * ratio, ratio * ratio, np.array([slope, offset, bias])


def _probability(margins: np.ndarray, good: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps with a small ridge."""
    if good.all() or not good.any():
        return 1.0, 0.0
    weights = weights / weights.mean()
    target = np.where(good, 1 - 1 / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weights * (p - target)) + 1e-3 * theta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def labelled(labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per labelled document that may be learnt from: ``doc_id``, ``label`` 0 or 1.

    Left out are documents with crc32(doc_id as text) mod 5 = 0, null ids, null labels, and
    documents whose labels differ. Repeated rows count once.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    both = usable.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return both.where("label = _most").select("doc_id", F.col("label").cast("int").alias("label"))


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE_PER_LABEL, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model, from about ``per_label`` labelled documents of each label.

    Rows are chosen by a hash of the id against a share, so the sample needs no sort and its
    size is bounded (its deviation is that of a binomial count). All data that reaches the one
    fitting task, and the model that reaches the driver, are of that bounded size: of each text its
    different indicators, 4 bytes each and WIDTH at most, so 2 * ``per_label`` * WIDTH * 4 bytes at the
    very worst, when all chosen texts are megabytes long, and a hundredth of that on usual ones.
    """
    known = labelled(labels, label)
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, min(1.0, per_label / max(sizes.get(1, 0), 1))).otherwise(min(1.0, per_label / max(sizes.get(0, 0), 1)))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(chance < share).select(F.col("doc_id").alias("_id"), "label", (1 / share).alias("weight"))
    named = docs.select(F.col("doc_id").alias("_id"), "text")  # no other column is looked at
    texts = named.join(F.broadcast(sample), "_id").select("_id", "text", "label", "weight")
    # One text of each id, however often its rows are repeated.
    order = F.row_number().over(W.partitionBy("_id").orderBy(F.xxhash64("text")))
    texts = texts.withColumn("_n", order).where("_n = 1").drop("_n")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for batch in batches:
            for start, piece in text_pieces(batch.column(1)):
                found = indicators.of_texts(piece)
                rest = batch.slice(start, len(piece))
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(2), rest.column(3), pa.array([f.tobytes() for f in found], pa.binary())],
                    names=["_id", "label", "weight", "found"],
                )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks, stands = [], [], []
        for batch in batches:
            rows += [np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()]
            marks += batch.column(1).to_pylist()
            stands += batch.column(2).to_pylist()
        model = fit(rows, np.array(marks, int), np.array(stands, float), rounds=rounds)
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in model], names=["w", "squares", "curve"])

    sampled = texts.mapInArrow(features, "_id bigint, label int, weight double, found binary")
    model = sampled.repartition(1).sortWithinPartitions("_id", "found").mapInArrow(fitted, "w binary, squares binary, curve binary").collect()
    if not model:
        return fit([], np.zeros(0, int), np.zeros(0))
    return tuple(np.frombuffer(bytes(x), np.float64) for x in model[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each text (null: empty). Other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: WIDTH weights
    out = free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, squares, (slope, offset, bias) = shared.value
        indicators = Indicators()
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for start, piece in text_pieces(batch.column(batch.schema.get_field_index(text))):
                for i, found in enumerate(indicators.of_texts(piece)):
                    margin = w[found].sum() / max(np.sqrt(squares[found].sum()), 1e-12) + bias
                    scores[start + i] = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{out}` double")


#: Documents of a lower score are predicted to have label 0.
THRESHOLD = 0.3


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out from training, its score and its predicted label."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
