"""Removed bytes against brute force, hot grams, ties, empty and long texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retally.llm import suffix_dedup

SCHEMA = "doc_id long, text string, spans int, extra string"


def brute(texts: list[str | None], length: int = suffix_dedup.LENGTH) -> list[tuple[list[tuple[int, int]], bytes]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((spans, bytes(b for b, g in zip(d, gone[1:-1]) if not g)))
    return out


def texts(seed: int) -> list[str | None]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(70), prose(30)[:150]
    out: list[str | None] = [None, "", "a" * 199, "a" * 200, "a" * 201, "a" * 5000, "ab" * 400, prose(300) * 2]
    out += [prose(r.randint(0, 60)) + passage[r.randint(0, 40) :] + prose(r.randint(0, 60)) for _ in range(25)]
    out += [prose(20) + line + prose(20) for _ in range(40)]
    copy = prose(200)
    return out + [copy] * 5 + [copy[:500] + "x" + copy[501:], copy[7:], prose(3000)]


@pytest.mark.parametrize("most", [suffix_dedup.MOST_CONTEXTS, 3])
def test_equals_brute_force(spark, monkeypatch, most):
    """With few contexts sorted together, hot grams are told apart by longer strings first."""
    rows = [(i, t, 0, "x") for i, t in enumerate(texts(most))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (most,))
    found = suffix_dedup.dedup(docs)
    assert found.columns == ["doc_id", "text", "spans", "extra", "_spans", "kept"]
    got = {r["doc_id"]: ([tuple(s) for s in r["_spans"]], bytes(r["kept"])) for r in found.collect()}
    assert [got[i] for i in range(len(rows))] == brute([t for _, t, *_ in rows])


def test_repeated_rows_null_ids_and_one_id_for_two_texts(spark):
    long = "".join(random.Random(5).choices("abcdefgh", k=400))
    rows = [(1, long), (1, long), (None, long[:250]), (None, "z" * 150), (2, "q" * 90), (2, long[::-1])]
    found = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found)
    assert gone == [("1", 400, 400, 1), ("1", 400, 400, 1), ("2", 90, 0, 0), ("2", 400, 0, 0), ("None", 150, 0, 0), ("None", 250, 250, 1)]


def test_many_texts_under_a_null_id(spark):
    """5,000 different texts of one id: what one of them repeats is not cut from another."""
    r = random.Random(6)
    prose = lambda n: "".join(r.choices("abcdefghij", k=n))
    passages = [prose(230) for _ in range(40)]
    rows = [prose(r.randint(120, 260)) + (r.choice(passages) if i % 2 else prose(230)) + prose(40) for i in range(5000)]
    found = suffix_dedup.dedup(spark.createDataFrame([(None, t) for t in rows], "doc_id long, text string").repartition(4)).collect()
    got = {x["text"]: ([tuple(s) for s in x["spans"]], bytes(x["kept"])) for x in found}
    assert len(found) == len(rows) and got == dict(zip(rows, brute(rows)))


def test_empty_table(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_characters(spark):
    shared = "x" * 100 + "".join(chr(97 + i % 23) for i in range(150))
    rows = [(1, "é" + shared + "é"), (2, "è" + shared + "è")]  # one byte of either letter is shared
    found = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole_characters=True)
    assert {r["doc_id"]: r["t"] for r in found.withColumn("t", F.col("kept").cast("string")).collect()} == {1: "éé", 2: "èè"}


def test_mergesort_sorts_each_group():
    r = random.Random(2)
    blobs = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(300)]
    group = np.sort(np.array([r.randint(0, 20) for _ in blobs]))
    length = np.array([len(b) for b in blobs])
    begin = np.cumsum(length) - length
    data = np.frombuffer(b"".join(blobs), np.uint8)
    ahead = suffix_dedup.Suffixes(data, begin, length, back=False).sorted(group)
    assert [(group[i], blobs[i]) for i in ahead] == sorted(zip(group, blobs))
    behind = suffix_dedup.Suffixes(data, begin + length, length, back=True).sorted(group)
    assert [(group[i], blobs[i][::-1]) for i in behind] == sorted((g, b[::-1]) for g, b in zip(group, blobs))


def test_contexts_whose_first_hashes_agree_by_chance_are_different():
    """With a first hash that is always the same, the second one and the bytes decide."""
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("abcdef"), 260)) for _ in range(4)]
    texts[3] = texts[0]
    data, offsets = suffix_dedup.bytes_of(pa.array(texts))
    found = suffix_dedup.anchors(data, offsets)
    one = np.zeros(len(found["key"]), np.uint64)
    meeting = suffix_dedup._Meeting()
    order = np.lexsort((found["proof"], one, one))
    table = pa.table({"key": one[order].view(np.int64), "context": one[order].view(np.int64), "proof": found["proof"][order].view(np.int64), "text": found["text"][order]})
    equal, _, met = meeting.add(table)
    texts_equal = set(met.column("text").to_numpy()[equal].tolist())
    assert texts_equal == {0, 3}
