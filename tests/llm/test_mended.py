"""Names that clash, marks inside messages, repeated rows, special tokens, and two models against plain ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retally.llm import ann, chat, mixing, near_dup, quality, suffix_dedup, token_files
from retally.llm.queries import TOKENIZERS

WORDS = f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.mark.parametrize("name", ["_id", "_digest", "_own", "_n", "own", "row", "order", "text2"])
def test_one_of_each_keeps_columns_of_any_name(spark, name):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text, 7), (1, text + " more", 8), (None, "other", 9), (None, "other", 9)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` int")
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, text + " more", 8), (None, "other", 9)]


@pytest.mark.parametrize("name", ["label", "weight", "_id", "_n", "found"])
def test_train_does_not_look_at_other_columns(spark, name):
    rows = [(i, "good words here" if i % 2 else "b!! c%%", 5) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels))
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) and r[name] == 5 for r in scored.collect())


@pytest.mark.parametrize("name", ["__spans", "__doc", "_spans", "_doc", "_tag", "tag", "start"])
def test_dedup_keeps_columns_of_any_name(spark, name):
    long = "".join(chr(97 + i % 26) + str(i) for i in range(300))
    docs = spark.createDataFrame([(1, long, 3), (2, "x" + long, 4), (3, "short", 5)], f"doc_id long, text string, `{name}` int")
    found = suffix_dedup.dedup(docs)
    assert found.columns[:3] == docs.columns
    assert sorted((r["doc_id"], r[name], bytes(r["kept"])) for r in found.collect()) == [(1, 3, b""), (2, 4, b"x"), (3, 5, b"short")]


def test_equal_rows_do_not_list_their_spans_again(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(1000))
    docs = spark.range(5000).selectExpr("cast(null as bigint) as doc_id", f"'{text}' as text").repartition(4)
    found = suffix_dedup.dedup(docs)
    rows = found.groupBy("kept", "spans").count().collect()
    assert [(bytes(r["kept"]), [tuple(s) for s in r["spans"]], r["count"]) for r in rows] == [(b"", [(0, 1000)], 5000)]


@pytest.mark.parametrize("role", ["ab", "", "", "x", "[/ROLE] ", "a [INST] ", "user\\"])
@pytest.mark.parametrize("text", ["hi", "", "", "", " [/TURN]"])
def test_marks_in_messages_are_not_mistaken(role, text):
    messages = [("user", "q"), (role, text), ("assistant", text), (role, "" * 3)]
    formatted, found, rewritten = chat.spans(messages, chat.instruction_template)
    assert not rewritten
    for (_, own), (start, stop, a, b) in zip(messages, found):
        assert chat.unescape(formatted[a:b]) == own and start <= a <= b <= stop


def test_roles_with_marks_are_read_back(spark):
    rows = [(1, 0, "ab", "hi"), (1, 1, "assistant", ""), (2, 0, "", "")]
    made = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {(r["conv_id"], i, m["role"], m["text"]) for r in made.collect() for i, m in enumerate(r["messages"])}
    assert got == set(rows)


def test_special_tokens_are_the_librarys():
    with open(WORDS) as file:
        definition = file.read()
    library, encoder = Tokenizer.from_str(definition), token_files.WordEncoder(definition)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b c", "<|ENDOFTEXT|> x", "<|endoftext|", "plain", "İ<|endoftext|>é", ""]
    for _ in range(2):
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in got[0]


# --- the quality model against a dense one ----------------------------------------------------


def plain_indicators(text: str) -> list[int]:
    """The indicators of a short text, one n-gram after the other."""
    data, out = text.encode(), set()
    for n in quality.LENGTHS:
        for i in range(len(data) - n + 1):
            code = sum(b << (8 * k) for k, b in enumerate(data[i : i + n]))
            out.add((code * 2654435761 + (n * 0x9E3779B1 & 0xFFFFFFFF)) % (1 << 32) >> (32 - quality.BITS))
    words = text.split()
    signs = "".join(str(int(a == b)) for a, b in zip(words, words[1:]))
    for n in range(1, quality.SIGNS + 1):
        out |= {(1 << quality.BITS) + int("1" + signs[i : i + n], 2) for i in range(len(signs) - n + 1)}
    return sorted(out)


def dense_machine(x, sign, cost):
    """Hinge loss with a bias by the dual problem over the whole kernel matrix, until nothing changes."""
    kernel = (x @ x.T + 1) * np.outer(sign, sign)
    dual = np.zeros(len(x))
    for _ in range(200_000):
        before = dual.copy()
        for i in range(len(x)):
            dual[i] = min(max(dual[i] + (1 - kernel[i] @ dual) / kernel[i, i], 0), cost[i])
        if np.abs(dual - before).max() < 1e-14:
            break
    return (dual * sign) @ x, float((dual * sign).sum())


def test_quality_equals_a_dense_model(spark):
    draw = random.Random(8)
    word = lambda good: draw.choice(["alpha", "beta", "gamma", "delta"] if draw.random() < (0.7 if good else 0.3) else ["b!!", "c%%", "d&&", "the"])
    texts = {i: " ".join(word(i % 3 > 0) for _ in range(draw.randint(1, 9))) for i in range(1, 46)}
    texts[46] = ""
    labels = {i: int(i % 3 > 0) for i in texts if i % 7}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([*labels.items()], "doc_id long, quality int"), rounds=4000)
    got = quality.score(docs, model).collect()

    import zlib

    learnt = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    good = np.array([labels[i] == 1 for i in learnt])
    dense = lambda ids: np.array([np.isin(np.arange(quality.WIDTH), plain_indicators(texts[i])) for i in ids], float)
    has = dense(learnt)
    shares = [(has[good == g].sum(0) + 1) / ((good == g).sum() + 2) for g in (False, True)]
    ratio = np.log(shares[1] / shares[0])
    scaled = lambda m: m * ratio / np.maximum(np.sqrt(((m * ratio) ** 2).sum(1)), 1e-12)[:, None]
    x, sign = scaled(has), np.where(good, 1.0, -1.0)
    cost = np.where(good, len(x) / (2 * good.sum()), len(x) / (2 * (~good).sum()))
    back = np.random.default_rng(1).permutation(len(x)) % 5 == 0
    w, bias = dense_machine(x[~back], sign[~back], cost[~back])
    slope, offset = quality._probability(x[back] @ w + bias, good[back], np.ones(back.sum()))
    w, bias = dense_machine(x, sign, cost)
    margins = scaled(dense(sorted(texts))) @ w + bias
    want = dict(zip(sorted(texts), 1 / (1 + np.exp(-(slope * margins + offset)))))
    assert {r["doc_id"] for r in got} == set(want)
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 1e-6


# --- many sources ------------------------------------------------------------------------------


def test_ten_thousand_sources_are_split_in_short_rows(spark):
    """Three tiers of groups; every quota is met exactly, shards are equal, no source favours one."""
    sources = spark.range(10_000).select(F.col("id").alias("rank"), F.when(F.col("id") == 7, 50_000).otherwise(F.col("id") % 13).cast("long").alias("quota"))
    before = mixing.GROUP
    mixing.GROUP = 30
    try:
        cells = mixing.split(sources, levels=3).collect()
    finally:
        mixing.GROUP = before
    got, first, shards = {}, {}, [0] * 8
    for r in sorted(cells, key=lambda r: r["shard"]):
        assert r["first"] == got.get(r["rank"], 0) and r["quota"] >= 0
        got[r["rank"]] = got.get(r["rank"], 0) + r["quota"]
        shards[r["shard"]] += r["quota"]
    assert got == {i: 50_000 if i == 7 else i % 13 for i in range(10_000)}
    assert max(shards) - min(shards) <= 1
    hot = [r["quota"] for r in cells if r["rank"] == 7]
    assert all(abs(q - 50_000 / 8) < 600 for q in hot)
    twelve = [sum(r["quota"] for r in cells if r["rank"] % 13 == 12 and r["shard"] == k) for k in range(8)]
    assert max(twelve) - min(twelve) < 0.15 * sum(twelve) / 8


def test_shards_follow_the_words():
    assert mixing.levels_for(0) == mixing.levels_for(1e9) == mixing.LEVELS
    assert mixing.levels_for(mixing.SHARD_WORDS * 1000) == 10


# --- the whole search on many lists ------------------------------------------------------------


def test_recall_of_the_query_on_many_lists(spark):
    """The query as registered, on 50,000 vectors without structure (250 lists), against all of them."""
    draw = np.random.default_rng(11)
    matrix = draw.standard_normal((50_000, 32)).astype(np.float32)
    matrix /= np.sqrt((matrix * matrix).sum(1))[:, None]
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(matrix)), "embedding": list(matrix.tolist())})).repartition(8)
    found: dict[int, set] = {}
    for r in ann.search_embeddings(table).where("query_id % 200 = 0").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    wide, hits = matrix.astype(np.float64), 0
    asked = range(0, len(matrix), 200)
    for q in asked:
        scores = wide @ wide[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-scores, 20)[:20].tolist()))
    recall = hits / (20 * len(asked))
    print("recall", recall)
    assert recall >= 0.9 and len(found) == len(asked)
