"""WARC, nearest neighbours, mixing, near duplicates: nulls, ties, hot groups, empty tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retally.llm import ann, mixing, near_dup, warc

PAGES = "page_id long, url string, html string, kind int"


def trap(depth: int) -> str:
    """Text that looks like records, with lengths that lead to other such places."""
    inner = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n{'y' * n}\r\n\r\n" for n in (0, 7, 40, 900)) + "WARC/1.1\r\nContent-Length: 1000000000\r\n\r\n"
    return inner * depth + "WARC/1.1\r\nContent-Length: x\r\n\r\nWARC/1.0"


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_archives_round_trip_with_magic_in_payloads(spark, folder, block):
    texts = [None, "", trap(1), trap(5), "é" * 3000, trap(2) + "z" * 50_000, "same", "same", "same"]
    rows = [(None if i == 4 else i, f"http://x/{i}\r\nWARC/1.1" if i else None, t, 1) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc.write(pages, f"file://{folder}/warc", file_bytes=30_000)
    records = warc.read(manifest, block)
    assert records.where("kind = 'warcinfo'").count() == manifest.count()
    assert records.count() == len(rows) + manifest.count() == manifest.agg(F.sum("n_records")).first()[0]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_rows(records).collect()}
    first: dict = {}
    for i, _, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(t or "", i)
    want = {}
    for i, _, t, _ in rows:
        least = first.get(t or "")
        again = least is not None and least != i
        want[i] = (len((t or "").encode()), "revisit" if again else "response", least if again else None)
    assert got == want


def test_a_damaged_file_is_read_up_to_the_damage(spark, folder):
    pages = spark.createDataFrame([(i, "u", "p" * 100, 1) for i in range(5)], PAGES).coalesce(1)
    path = warc.write(pages, folder).first()["path"]
    with open(path, "rb") as file:
        data = file.read()
    cut = data.rindex(b"WARC/1.1") + 3
    with open(f"{path}.cut", "wb") as file:
        file.write(data[:cut])
    manifest = spark.createDataFrame([(f"{path}.cut", cut)], "path string, n_bytes long")
    assert warc.read(manifest, 128).where("kind <> 'warcinfo'").count() == 4


@pytest.mark.parametrize("block", [1000, 1 << 20])
def test_a_very_long_url_and_a_wrong_count(spark, folder, block):
    urls = ["u", "v" * 200_000, " " * 70_000, "w", trap(3)]
    pages = spark.createDataFrame([(i, u, f"p{i}", 1) for i, u in enumerate(urls)], PAGES).coalesce(1)
    manifest = warc.write(pages, f"file://{folder}/warc-long")
    got = warc.read(manifest, block).where("kind <> 'warcinfo'").collect()
    assert sorted((r["record_id"], len(r["headers"]["warc-target-uri"])) for r in got) == [(f"<urn:x-page:{i}>", len(warc._line(u))) for i, u in enumerate(urls)]
    with pytest.raises(ValueError, match="records"):
        warc.read(manifest.withColumn("n_records", F.col("n_records") + 1), block)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_neighbours_of_few_equal_and_unusable_vectors(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(0, 90)] + [(100, [0.0, 0.0]), (120, None), (140, [1.0, None]), (160, [float("nan"), 1.0])]
    rows += [(180, [float("inf"), 0.0]), (200, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (20, [1.0, 2.0])]  # the last is a repeated row
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    good = {i: np.array(v) for i, v in rows[:90]}
    found: dict = {}
    for r in ann.search_embeddings(table).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == [0, 20, 40, 60, 80]
    for query, got in found.items():
        want = sorted(((-float(good[query] @ v), i) for i, v in good.items() if i != query))[:20]
        assert sorted(got) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_fewer_candidates_than_results_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [-1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search_embeddings(table).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0)]
    assert ann.search_embeddings(table.limit(0)).collect() == []
    assert ann.search_embeddings(table.where("vec_id = 0")).collect() == []


def test_long_lists_are_dealt_to_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 30), ("LIST", 100), ("PROBE_RATIO", 9.0)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(1)
    vectors = r.normal(size=(400, 6)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    wide = vectors.astype(float)
    for query, group in _by_query(ann.search_embeddings(table)).items():
        scores = wide @ wide[query]
        scores[query] = -9e9
        assert group == np.lexsort((np.arange(400), -scores))[:20].tolist()


def _by_query(found):
    out: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_graph_search_finds_the_nearest_centres():
    r = np.random.default_rng(2)
    centres, queries = r.normal(size=(300, 8)), r.normal(size=(50, 8))
    far = ann.CentreGraph(centres).search(queries, 1.3)
    exact = ann.squared(queries, centres)
    assert np.mean(far.min(1) <= exact.min(1) + 1e-9) > 0.98
    assert np.allclose(far[np.isfinite(far)], exact[np.isfinite(far)])


def test_recall_does_not_shrink_with_the_number_of_lists(spark):
    """With many lists of vectors without structure, the least ratio finds too few; the measured one
    finds enough, for other queries than those it was measured on too."""
    draw = np.random.default_rng(3)
    matrix = draw.normal(size=(12_000, 64))
    matrix /= np.sqrt((matrix * matrix).sum(1))[:, None]
    norm = 1.0
    centres = ann.fit_centres(ann.lifted(matrix, norm), 1200, rounds=4)
    graph = ann.CentreGraph(centres)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "query long, vector array<double>").repartition(3)
    exact = lambda part: [matrix[[j for j in np.argsort(-(matrix @ q), kind="stable")[:21] if (matrix[j] != q).any()][:20]] for q in part]
    near = ann.exact_neighbours(frame, matrix[:40], 20)
    assert all(sorted(map(tuple, a)) == sorted(map(tuple, b)) for a, b in zip(near, exact(matrix[:40])))
    others = matrix[500:600]
    assert ann.recall_of(others, exact(others), graph, norm, ann.PROBE_RATIO) < 0.9
    ratio = ann.measured_ratio(frame, frame, centres, norm, 20)
    assert ann.recall_of(others, exact(others), graph, norm, ratio) >= 0.9


def test_hypergeometric_draws(spark):
    for total, kind, drawn in ((10, 4, 5), (40, 39, 20), (7, 0, 3), (6, 6, 2), (1000, 300, 500), (0, 0, 0)):
        sql = mixing._hypergeometric("n", "k", "d", "chance")
        rows = spark.range(0, 2000, numPartitions=2).select(
            F.lit(total).cast("long").alias("n"), F.lit(kind).cast("long").alias("k"), F.lit(drawn).cast("long").alias("d"), ((F.col("id") + 0.5) / 2000).alias("chance")
        )
        got = [r[0] for r in rows.select(F.expr(sql)).collect()]
        whole = math.comb(total, drawn)
        share = {x: math.comb(kind, x) * math.comb(total - kind, drawn - x) / whole for x in range(max(0, drawn - total + kind), min(kind, drawn) + 1)}
        assert set(got) <= set(share)
        assert all(abs(got.count(x) / 2000 - p) <= 0.001 for x, p in share.items())


def documents(spark, rows):
    return spark.createDataFrame([(i, s, "w " * n if n is not None else None, "x", 1) for i, s, n in rows], "doc_id long, source string, text string, rank string, _size int")


def test_mix_draws_each_block_once_and_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "a", "b", None, "ü"]), r.randint(0, 30)) for i in range(3000)]
    docs = documents(spark, rows).select("doc_id", "source", "text")
    sources, drawn = mixing.plan(docs, block=8, levels=3)
    assert drawn.count() == drawn.select("rank", "copy", "block").distinct().count() == sources.agg(F.sum("quota")).first()[0]
    per_shard = [r["count"] for r in drawn.groupBy("shard").count().collect()]
    assert len(per_shard) == 8 and max(per_shard) - min(per_shard) <= 1
    found = {r["doc_id"]: r for r in mixing.digests(docs, block=8, levels=3).collect()}
    sums: dict = {}
    for i, s, n in rows:
        assert found[i]["size"] == n and found[i]["taken"] in (0, n, 2 * n)
        sums[s] = sums.get(s, 0) + found[i]["taken"]
    target = {s: found[i]["target"] for i, s, _ in rows}
    assert all(abs(sums[s] - target[s]) <= 15.5 for s in sums)
    assert abs(sum(target.values()) - 1.5 * sum(n for *_, n in rows)) < 1e-6
    mixed = mixing.mix(docs, block=8, levels=3)
    assert mixed.columns == docs.columns
    counts: dict = {}
    for row in mixed.collect():
        counts[row["doc_id"]] = counts.get(row["doc_id"], 0) + 1
    assert all(counts.get(i, 0) * n == found[i]["taken"] for i, _, n in rows)
    assert [r["doc_id"] for r in mixed.collect()] == [r["doc_id"] for r in mixing.mix(docs, block=8, levels=3).collect()]


def test_mix_of_odd_tables(spark):
    rows = [(None, "a", 3), (None, "a", 3), (1, "a", 0), (1, None, None), (2, None, 5), (2, None, 5), (3, "z", 0)]
    found = mixing.digests(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    wide = documents(spark, rows)
    assert mixing.mix(wide).columns == wide.columns
    assert mixing.digests(wide.limit(0)).collect() == [] and mixing.mix(wide.limit(0)).collect() == []
    nothing = mixing.digests(documents(spark, [(1, "a", 0), (2, "b", None)])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in nothing)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_banded_alignment_is_exact_where_it_counts():
    r = random.Random(6)
    for _ in range(400):
        a = [r.randint(0, 40) for _ in range(r.randint(1, 60))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.randint(0, 40))
        x, y = (np.array(s, np.uint64) for s in (a, b))
        if not b:
            continue
        m = lcs(a, b)
        exact = m / (len(a) + len(b) - m)
        got = near_dup.similarity(x, y, near_dup.BORDER)
        assert got == exact if exact >= near_dup.BORDER else got < near_dup.BORDER or got == exact


def test_sketches_depend_on_order_and_occurrence():
    words = np.random.default_rng(1).integers(0, 2**60, 300).astype(np.uint64)
    where = np.array([0, 300])
    one = near_dup.order_sketches(near_dup.labelled(words, where), where, 30)
    back = near_dup.order_sketches(near_dup.labelled(words[::-1].copy(), where), where, 30)
    assert (one == back).mean() < 0.2
    twice = np.concatenate([words, words])
    assert len(set(near_dup.labelled(twice, np.array([0, 600])).tolist())) == 600
    few = near_dup.order_sketches(near_dup.labelled(words[:1], np.array([0, 0, 1])), np.array([0, 0, 1]), 4)
    assert few.shape == (1, 4)


def test_components_of_chains_and_stars(spark):
    r = random.Random(8)
    chain = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    r.shuffle(chain)
    found = near_dup.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_near_duplicates_of_odd_texts(spark):
    r = random.Random(9)
    base = [f"{r.choice('abc')}{i}" for i in range(200)]
    near = lambda k: " ".join(w if j % 97 != k else "other" for j, w in enumerate(base))
    rows = [(5, " ".join(base)), (4, near(3)), (3, near(11)), (3, near(11)), (None, near(20)), (7, " ".join(base).upper() + "!")]
    rows += [(10, None), (11, ""), (12, "!!"), (13, "a b"), (14, "A, b."), (15, "a c"), (20, " ".join(reversed(base)))]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, label string, class_id int").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_dup.classes(docs).collect())
    want = {5: 3, 4: 3, 3: 3, None: 3, 7: 3, 10: 10, 11: 10, 12: 12, 13: 13, 14: 13, 15: 15, 20: 20}
    assert got == sorted((str(i), str(want[i])) for i, _ in rows)
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 10, 12, 13, 15, 20]
    assert near_dup.classes(docs.limit(0)).collect() == [] and near_dup.one_of_each(docs.limit(0)).collect() == []


def test_a_family_linked_only_through_its_base(spark):
    """Variants are like their base but not like one another; the leader is some variant."""
    r = random.Random(10)
    base = [f"w{r.randint(0, 10**9)}" for _ in range(300)]
    def variant(k):
        out = list(base)
        for j in range(6):
            out[(k * 29 + j * 49) % 300] = f"v{k}x{j}"
        return " ".join(out)
    rows = [(i, variant(i)) for i in range(1, 40)] + [(50, " ".join(base))]
    found = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in found} == {1}


def families(seed: int) -> list[str]:
    """Texts on templates: members of families fill one in differently, far from one another or
    near, and pairs of members are alike; chains drift away from their first text."""
    r = random.Random(seed)
    out = []
    for share in (0.5, 0.7, 0.8):
        base = [f"w{r.randint(0, 10**9)}" for _ in range(240)]
        own = int(len(base) * (1 - share) / 2)
        for _ in range(14):
            text, at = list(base), r.randrange(len(base) - own)
            text[at : at + own] = [f"v{r.randint(0, 10**9)}" for _ in range(own)]
            for _ in range(r.choice((1, 1, 2, 3))):
                out.append(" ".join(text))
                for j in r.sample(range(len(base)), r.choice((1, 2, 4))):
                    text[j] = f"x{r.randint(0, 10**9)}"
    return out


def test_families_on_templates_against_all_pairs(spark, monkeypatch):
    """No pair of texts that agree in a band is lost. One band that all members of a template share
    makes all texts one bucket, and blocks are small."""
    import pyarrow as pa

    from retally.llm.common import shingle_hashes, word_hashes

    texts = families(12)
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
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    monkeypatch.setattr(near_dup, "BLOCK", 9)
    own = near_dup._digested(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    monkeypatch.setattr(near_dup, "_buckets", lambda docs: docs.select(F.lit(7).cast("long").alias("bucket"), (F.size(F.split("text", " ")) - 4).alias("size"), "digest"))
    found = near_dup.classes(own.select("doc_id", "text")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {i: root(i) for i in range(len(texts))}
