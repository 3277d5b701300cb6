"""Queries with SQL against DuckDB, the others against plain Python, on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

import compare
import corpus_pipeline
from conftest_llm import FOLDER
from retally.llm import near_dup, quality
from retally.llm.queries import ORACLES, QUERIES, TOKENIZERS

#: Fixed value: the pattern that splits texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def duck():
    return compare.duck(FOLDER)


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def result(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def byte_pairs():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare.difference(QUERIES[name], ORACLES[name], spark, FOLDER, duck) is None


def test_byte_bpe(spark, documents):
    encoding = byte_pairs()
    want = {}
    for doc_id, text in documents:
        ids = encoding.encode_ordinary(text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[doc_id] = (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in result(spark, "op3_byte_bpe")}
    assert got == want


def test_near_duplicates(spark, documents):
    """Classes of all pairs that the similarity links, found without buckets."""
    import pyarrow as pa

    from retally.llm.common import shingle_hashes, word_hashes

    texts = sorted({t for _, t in documents})
    hashes, where = shingle_hashes(*word_hashes(pa.array(texts), plain=True), near_dup.SHINGLE)
    runs = [hashes[a:b] for a, b in zip(where[:-1], where[1:])]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_dup.similarity(runs[i], runs[j], near_dup.BORDER) >= near_dup.SIMILAR:
                parent[root(i)] = root(j)
    label = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for doc_id, text in documents:
        least.setdefault(label[text], doc_id)
    got = {r["doc_id"]: r["class_id"] for r in result(spark, "op4_near_dup")}
    assert got == {d: least[label[t]] for d, t in documents}


def test_quality(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")  # the smallest one has 19 held-out labels
    duck = compare.duck(folder)
    rows = {r["doc_id"]: r for r in QUERIES["op5_quality"](spark, folder).collect()}
    truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    for doc_id, row in rows.items():
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= quality.THRESHOLD)
    held = [(truth[d], r["predicted"]) for d, r in rows.items() if r["held_out"] and d in truth]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_token_files(spark, documents):
    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    want, start = {}, 0
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, "op6_token_files")}
    assert got == want


def test_fingerprints(spark, documents):
    rows = {r["doc_id"]: r for r in result(spark, "op7_fingerprints")}

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    def likeness(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    gaps = []
    for i, (doc_id, text) in enumerate(documents):
        following = documents[(i + 1) % len(documents)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = rows[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        gaps += [abs(row["near_edited"] - likeness(text, edited)), abs(row["near_next"] - likeness(text, following))]
        if len(shingles(text) | shingles(edited)) <= 128:
            assert gaps[-2] < 1e-9
    assert max(gaps) < 0.25 and np.mean(gaps) < 0.03


def test_nearest_neighbours(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found: dict[int, list] = {}
    for r in result(spark, "op9_ann"):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == ids[ids % 20 == 0].tolist()
    hits = 0
    for query, got in found.items():
        scores = (vectors * vectors[ids == query]).sum(1)
        scores[ids == query] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        assert np.allclose([scores[ids == g[1]][0] for g in got], [g[2] for g in got], rtol=0, atol=1e-12)
        hits += len(best & {g[1] for g in got})
    assert hits / (20 * len(found)) >= 0.9


def test_pipeline_is_its_stages_and_each_is_right(spark, duck, documents):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), f"test-{name}")
        rows = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows} if name != "byte_bpe" else {}
        if name == "quality":
            truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
            assert all(after[d] == before[d] for d in after)
            good = [d for d in before if truth.get(d) == 1]
            assert sum(d in after for d in good) >= 0.97 * len(good)
            assert sum(d in after for d in before if truth.get(d) == 0) <= 0.3 * sum(truth.get(d) == 0 for d in before)
        elif name == "near_duplicates":
            assert len(rows) == len(after) == len(set(after.values()))
            assert all(after[d] == before[d] for d in after)
        elif name == "repeated_strings":
            data = {d: (t or "").encode() for d, t in before.items()}
            seen: dict[bytes, int] = {}
            for d in data.values():
                for i in range(len(d) - 199):
                    seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
            assert set(after) == set(before)
            for doc_id, d in data.items():
                gone = np.zeros(len(d), bool)
                for i in range(len(d) - 199):
                    if seen[d[i : i + 200]] > 1:
                        gone[i : i + 200] = True
                left = bytes(np.frombuffer(d, np.uint8)[~gone])
                assert (after[doc_id] or "").encode().decode() == left.decode(errors="ignore") or abs(len(after[doc_id].encode()) - len(left)) <= 6 * (1 + len(d) // 200)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "mixing":
            held = [(r["doc_id"], r["text"]) for r in rows]
            words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in before.items()}
            total, mixed = sum(words.values()), sum(words[d] for d, _ in held)
            assert abs(mixed - 1.5 * total) <= 0.02 * total
            assert all(before[d] == t for d, t in held)
            assert max(np.unique([d for d, _ in held], return_counts=True)[1]) <= 2
        else:
            encoding = byte_pairs()
            assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in held)
            texts = dict(held)
            assert all(r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]]) for r in rows)
        before = after
    assert os.path.exists(FOLDER) and duckdb  # the given tables are only read
