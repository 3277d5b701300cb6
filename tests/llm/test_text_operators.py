"""Byte-level BPE, token files, quality, fingerprints, chat: nulls, ties, empty and odd texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from test_queries import byte_pairs
from tokenizers import Tokenizer

from retally.llm import byte_bpe, chat, fingerprints, quality, token_files
from retally.llm.common import ordered_runs, shingle_hashes, text_pieces, word_hashes
from retally.llm.queries import TOKENIZERS

RANKS, WORDS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/word_bpe_49k.json"
PARTS = ["a", "Z", " ", "  ", "\n", "'", "s", "re", "'ll", "'ve", "1", "²", "é", "中", "!", "?", ".", ",", "\t", "'S", "🙂", "_"]
PARTS += ["\x1c", "\0", "̈", "<|endoftext|>", " ", "\x85", "İ", "Σ", "​", "É", "ß", "é", "K"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]
    return [*made, "", "'" * 700, "ab" * 900, " " * 500, "x\n\n" * 3, "word " * 5000]


def test_byte_bpe_equals_the_library():
    encoding, texts = byte_pairs(), odd_texts(3000)
    with open(RANKS, "rb") as file:
        vocabulary = byte_bpe.Vocabulary(file.read())
    ids, where, ends = byte_bpe.encode_texts(texts, vocabulary)
    for i, text in enumerate(texts):
        own = ids[where[i] : where[i + 1]].tolist()
        assert own == encoding.encode_ordinary(text), repr(text)
        assert ends[where[i] : where[i + 1]].tolist() == np.cumsum([len(vocabulary.pieces[x]) for x in own]).tolist()
    assert byte_bpe.decode_ids(ids, where, vocabulary) == [t.encode() for t in texts]


def test_byte_bpe_keeps_other_columns_rows_and_nulls(spark):
    rows = [(1, "a b", 7), (1, "a b", 7), (None, None, 8), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = byte_bpe.encode(docs, RANKS, decoded="decoded")
    assert found.columns == ["doc_id", "text", "ids", "_ids", "ends", "decoded"]
    got = sorted((str(r["doc_id"]), str(r["ids"]), r["_ids"], r["ends"], bytes(r["decoded"])) for r in found.collect())
    ids = byte_pairs().encode_ordinary("a b")
    assert got == [("1", "7", ids, [1, 3], b"a b")] * 2 + [("2", "None", [], [], b""), ("None", "8", [], [], b"")]
    again = byte_bpe.decode(found.select("doc_id", "_ids"), RANKS, ids="_ids")
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == [b"", b"", b"a b", b"a b"]
    assert byte_bpe.encode(docs.limit(0), RANKS).collect() == []


def test_word_encoder_equals_the_library():
    with open(WORDS) as file:
        definition = file.read()
    library, texts = Tokenizer.from_str(definition), odd_texts(3000, 2)
    encoder = token_files.WordEncoder(definition)
    for _ in range(2):  # from the library, then from the cache
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)]
        assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_token_files_are_equal_sequences_with_random_access(spark, folder):
    texts = [(5, "one two three " * 40), (None, None), (3, "x"), (3, "x"), (9, ""), (7, "seven")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    manifest = token_files.write(docs, WORDS, f"file://{folder}/tokens", runs=3, sequence=8)
    assert manifest.agg({"n_documents": "sum"}).first()[0] == 6
    found = sorted(((r["start"], r["doc_id"], len(bytes(r["ids"])) // 4) for r in token_files.read_documents(manifest).collect()))
    assert [f[1] for f in found] == [None, 3, 3, 5, 7, 9]
    assert [f[0] for f in found] == np.cumsum([0, *[f[2] for f in found[:-1]]]).tolist()
    path = max(manifest.collect(), key=lambda r: r["n_tokens"])["path"]
    batch = token_files.sequences(path, 0)
    assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 8)
    assert batch.column("mask").flatten().to_numpy(zero_copy_only=False).sum() <= batch.num_rows * 8
    assert token_files.digests(docs.limit(0), WORDS).collect() == []


def test_ordered_runs_keep_the_order_and_equal_keys(spark):
    keys = [None, *range(50), *[7] * 30, 10**15]
    found = ordered_runs(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 9).collect()
    rows = sorted((r["k"] is not None, r["k"] or 0, r["run"]) for r in found)
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert len({r["run"] for r in found if r["k"] == 7}) == 1 and len({r["run"] for r in found}) >= 6


def test_quality_of_tables_without_both_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)] + [(None, None)], "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(10)], [(1, 0), (1, 1), (None, 1), (2, None)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        rows = quality.predictions(docs, table).collect()
        assert len(rows) == 11 and len({r["score"] for r in rows}) == 1 and 0 < rows[0]["score"] < 1
    assert quality.predictions(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_quality_learns_from_its_labels_alone(spark):
    r = random.Random(3)
    text = lambda good: " ".join(r.choice(["alpha", "beta", "gamma"] if good else ["b!!", "c%%", "d&&"]) for _ in range(20))
    rows = [(i, text(i % 3 > 0), i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] * 2, "doc_id long, quality int")
    found = quality.score(docs, quality.train(docs, labels, per_label=50))
    assert found.columns == ["doc_id", "text", "score", "_score"]
    assert all((r["_score"] >= quality.THRESHOLD) == (r["doc_id"] % 3 > 0) for r in found.collect())


def test_sketches_are_the_smallest_hashes_and_merge():
    texts = ["", "one", "one two three four five six " * 200, " ".join(map(str, range(2000))), "a b c d e"]
    hashes, where = shingle_hashes(*word_hashes(pa.array(texts)), 5)
    for text, sketch, a, b in zip(texts, fingerprints.sketches(pa.array(texts), 16), where[:-1], where[1:]):
        assert sketch.tolist() == sorted(set(hashes[a:b].tolist()))[:16], text[:20]
    a, b, c = (np.unique(np.random.default_rng(i).integers(0, 500, 200).astype(np.uint64)) for i in range(3))
    one = fingerprints.merged(fingerprints.merged(a[:16], b[:16], 16), c[:16], 16)
    assert one.tolist() == np.unique(np.concatenate([a, b, c]))[:16].tolist()
    assert fingerprints.resemblance(a[:0], a[:0]) == 1 and fingerprints.resemblance(a[:0], a) == 0
    assert fingerprints.containment(a, np.union1d(a, b), 1000) == 1
    assert fingerprints.from_text(fingerprints.to_text(a)).tolist() == a.tolist()


def test_merged_fingerprints_of_groups(spark):
    words = [" ".join(str(j) for j in range(i, i + 40)) for i in range(60)]
    docs = spark.createDataFrame([(i % 2 or None, w) for i, w in enumerate(words)], "g long, text string").repartition(5)
    found = {r["g"]: r["fingerprint"] for r in fingerprints.merge(fingerprints.fingerprint(docs), ["g"]).collect()}
    for g in (None, 1):
        parts = [s for i, s in enumerate(fingerprints.sketches(pa.array(words))) if (i % 2 or None) == g]
        assert found[g] == fingerprints.to_text(np.unique(np.concatenate(parts))[: fingerprints.K])


@pytest.mark.parametrize("ids", [[1], [None, 1, 2], [4, 4, 9, 2], list(range(200))])
def test_edited_pairs(spark, ids):
    texts = [None if i == 3 else f"{i}é🙂 words of {i} " * (i % 5) for i in range(len(ids))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    rows = sorted(zip(ids, [t or "" for t in texts]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        want.append((str(i), t, following, t[: len(t) - len(t) // 2] + following[: len(t) // 2]))
    got = [(str(r["doc_id"]), r["text"], r["following"], r["edited"]) for r in fingerprints.edited_pairs(docs).collect()]
    assert sorted(got) == sorted(want)


def test_escape_is_reversible_and_breaks_controls():
    r = random.Random(4)
    parts = ["<", "s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/TURN]", "\\", "[", "a", "\n", "/", "<s>"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        made = chat.escape(text)
        assert chat.unescape(made) == text
        assert not chat.re.search(chat.CONTROLS, made)


def test_spans_find_turns_and_templates_that_rewrite():
    messages = [("system", "be [INST] kind"), ("user", ""), ("assistant", " hi </s>"), ("user", "x\\"), ("assistant", "")]
    text, found, rewritten = chat.spans(messages, chat.instruction_template)
    assert not rewritten and found[0][0] == 3 and found[-1][1] == len(text)
    assert [chat.unescape(text[a:b]) for *_, a, b in found] == [t for _, t in messages]
    last_only = lambda ms: "".join(t if i == len(ms) - 1 else "-" for i, (_, t) in enumerate(ms))
    assert chat.spans(messages[:3], last_only)[2]


def test_chat_with_nulls_and_repeated_rows(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (None, 0, "tool]", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: [(m["role"], m["text"], m["loss"]) for m in r["messages"]] for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert found == {
        1: [("", "first", False), ("user", "", False), ("assistant", "a", True), ("assistant", "b", True)],
        None: [("tool]", "t", False)],
    }
    assert [r["conv_id"] for r in chat.digests(table.limit(0)).collect()] == [-1]


def test_pieces_hold_every_text_once():
    column = pa.array([None, "a" * 10, "", "b" * 100, None, "c"])
    for most in (1, 15, 1000):
        pieces = list(text_pieces(column, most))
        assert [t for _, p in pieces for t in p.to_pylist()] == ["", "a" * 10, "", "b" * 100, "", "c"]
        assert [s for s, _ in pieces] == np.cumsum([0, *[len(p) for _, p in pieces[:-1]]]).tolist()
