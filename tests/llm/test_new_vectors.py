"""Whitening and cap filters: small cases against plain NumPy, and the recall of the filters."""

from __future__ import annotations

import numpy as np
import pytest

from conftest_llm import FOLDER
from retally.llm import cap_links, whitening
from retally.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


# --- whitening --------------------------------------------------------------------------------


def small_matrices():
    draw = np.random.default_rng(3)
    left, right = (np.linalg.qr(draw.standard_normal((24, 24)))[0] for _ in range(2))
    yield "one", np.array([[-3.0]])
    yield "normal", draw.standard_normal((24, 24))
    yield "identity", np.eye(9)
    yield "zero", np.zeros((4, 4))
    yield "rank one", np.ones((6, 6))
    yield "split", np.diag([3.0, 0, 2, 0, 1]) + np.diag([1.0, 0, 1, 1], 1)
    yield "clusters", left @ np.diag([3.0] * 8 + [2.0] * 8 + [1.0] * 8) @ right
    yield "close", left @ np.diag(np.r_[1 + 1e-9 * np.arange(23), 1e-5]) @ right
    yield "graded", left @ np.diag(10.0 ** -np.arange(24)) @ right


@pytest.mark.parametrize("name,matrix", list(small_matrices()), ids=lambda x: x if isinstance(x, str) else "")
def test_singular_directions(name, matrix):
    values, directions = whitening.singular_directions(matrix, len(matrix))
    want = np.linalg.svd(matrix, compute_uv=False)
    assert len(values) == (want > 2e-16 * len(matrix) * want[0]).sum() or name == "graded"
    assert np.abs(values - want[: len(values)]).max(initial=0) <= 1e-14 * want[0]
    assert np.abs(directions.T @ directions - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(matrix.T @ (matrix @ directions) - directions * values**2).max(initial=0) <= 1e-13 * want[0] ** 2


def test_small_values_are_relatively_accurate():
    """Of a bidiagonal matrix even the least values are found to many digits."""
    diagonal, above = 10.0 ** -np.arange(12), np.full(11, 1e-14)
    exact = np.sort(np.abs(diagonal))[::-1]  # what is above changes them by less than 1e-13 of themselves
    got = whitening.dqds(diagonal, np.minimum(above, diagonal[1:] * 1e-8))
    assert np.abs(got / exact - 1).max() < 1e-12


def expected_whitening(matrix, most=32):
    x = np.floor(64 * matrix.astype(float)) + 1_000_000
    away = x - x.mean(0)
    values, directions = np.linalg.eigh(away.T @ away / len(x))
    values, directions = values[::-1][:most], directions[:, ::-1][:, :most]
    keep = values > 1e-9 * values[0]
    return x, values[keep], (away @ directions[:, keep]) / np.sqrt(values[keep]), (values[keep] / np.trace(away.T @ away / len(x)))


def compare_whitening(rows, ids, matrix):
    x, values, want, shares = expected_whitening(matrix)
    n = len(x)
    got = np.zeros(want.shape)
    place = {i: k for k, i in enumerate(ids)}
    assert len(rows) == want.size
    for r in rows:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9
        assert r["n"] == n and r["identity_error"] < 1e-9
        whole = [int(v) for v in x[place[r["vec_id"]]]]
        sums = [int(s) for s in x.sum(0)]
        assert r["deviation"] == sum((n * v - s) ** 2 for v, s in zip(whole, sums))
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8


def test_whitening_query(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    compare_whitening(QUERIES["op12_whitening"](spark, FOLDER).collect(), table["vec_id"], np.stack(table["embedding"]))


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(5)
    good = [(i, draw.standard_normal(5).astype(np.float32).tolist(), None) for i in range(40)]
    good += [(100, [0.0] * 5, 1), (101, good[0][1], 1), (102, good[0][1], 1)]  # zero and equal vectors count
    bad = [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 5, 1), (203, [1.0] * 4 + [float("inf")], 1), (204, [], 1), (205, [1.0], 1)]
    df = vectors(spark, good + bad).repartition(7)
    compare_whitening(whitening.components_of(df).collect(), [r[0] for r in good], np.array([r[1] for r in good], np.float32))


def test_whitening_goes_through_the_tree(spark, monkeypatch):
    """More parts than meet in one task, some of them empty."""
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    draw = np.random.default_rng(6)
    rows = [(i, draw.standard_normal(3).astype(np.float32).tolist(), 0) for i in range(50)]
    df = vectors(spark, rows).repartition(9, "vec_id").where("vec_id % 3 > 0 OR vec_id < 20")
    kept = [r for r in rows if r[0] % 3 or r[0] < 20]
    compare_whitening(whitening.components_of(df).collect(), [r[0] for r in kept], np.array([r[1] for r in kept], np.float32))


def test_whitening_without_spread(spark):
    assert whitening.components_of(vectors(spark, [])).collect() == []
    assert whitening.components_of(vectors(spark, [(1, [1.0, 2.0], 0)] * 3)).collect() == []
    got = whitening.components_of(vectors(spark, [(1, [1.0, 2.0], 0), (None, [1.0, 4.0], 0)])).collect()
    assert sorted((r["vec_id"] is None, r["component"], abs(round(r["whitened"], 9)), r["explained"]) for r in got) == [
        (False, 1, 1.0, 1.0),
        (True, 1, 1.0, 1.0),
    ]


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(1, [1e12, 0.0], 0), (2, [0.0, 1.0], 0)]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["deviation"] for r in whitening.components_of(got).collect()} == {None}


# --- cap filters ------------------------------------------------------------------------------


def brute_links(rows):
    """n_links, component_id and kept of each row by comparing all pairs."""
    usable = []
    for k, (_, v, label) in enumerate(rows):
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(ok)
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (a, b))
                if (x @ y) / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[k][0], len(links[k]), least, rows[k][0] is not None and rows[k][0] == least))
    return sorted(out, key=str)


def got_links(df):
    return sorted(map(tuple, cap_links.link_counts(df).collect()), key=str)


def family(draw, dim, n, cosine):
    """Vectors around one direction; two of them have about the given cosine."""
    centre = draw.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    noise = draw.standard_normal((n, dim)) * np.sqrt((1 / cosine - 1) / dim)
    return (centre + noise).astype(np.float32)


@pytest.mark.parametrize("dim", [2, 8, 64])
def test_cap_links_equal_all_pairs(spark, dim):
    draw = np.random.default_rng(dim)
    made = [family(draw, dim, n, c) for n, c in ((40, 0.98), (60, 0.985), (5, 0.999))] + [draw.standard_normal((80, dim)).astype(np.float32)]
    all_of = np.concatenate(made)
    rows = [(int(i), v.tolist(), int(i % 9 == 0)) for i, v in zip(draw.permutation(len(all_of)), all_of)]
    assert got_links(vectors(spark, rows).repartition(5)) == brute_links(rows)


def test_cap_links_in_parts(spark, monkeypatch):
    """Filters of more vectors than one task takes at once."""
    monkeypatch.setattr(cap_links, "PART", 7)
    draw = np.random.default_rng(9)
    all_of = np.concatenate([family(draw, 16, 90, 0.982), draw.standard_normal((30, 16)).astype(np.float32)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(all_of)]
    assert got_links(vectors(spark, rows)) == brute_links(rows)


def test_cap_links_of_odd_rows(spark):
    one, two = [1.0, 0.0, 0.0], [2.0, 0.0, 0.0]
    rows = [
        (7, one, 0), (5, one, 0), (5, one, 0), (9, two, 0),  # equal, repeated, longer
        (1, one, None), (2, None, 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 0.0], 0), (6, [float("nan"), 0.0, 0.0], 0),
        (8, one, 1), (10, [1.0, 0.0], 0), (11, [], 0), (12, [-1.0, 0.0, 0.0], 0),
        (None, [0.0, 1.0, 0.0], 2), (None, [0.0, 1.0, 0.0], 2), (13, [0.0, 3e38, 0.0], 2), (14, [0.0, 1e-40, 0.0], 2),
    ]
    assert got_links(vectors(spark, rows)) == brute_links(rows)
    assert got_links(vectors(spark, [])) == []


def test_cap_links_keep_columns_of_any_name(spark):
    rows = [(1, [1.0, 0.0], 0, 8, 9, "x"), (2, [1.0, 0.0], 0, 8, 9, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int, _digest int, row string")
    got = cap_links.linked(df, "vec_id", "embedding", "label")
    assert got.columns == [*df.columns, "_n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "_digest", "row", "_n_links", "component_id", "kept").collect()) == [
        (1, 8, 9, "x", 1, 1, True),
        (2, 8, 9, "y", 1, 1, False),
    ]


@pytest.mark.parametrize("dim,total", [(16, 10_000), (64, 50_000), (64, 100_000_000), (256, 50_000)])
def test_pairs_at_the_limit_share_a_filter(dim, total):
    """Recall where it is least: pairs whose cosine is exactly 0.98."""
    draw = np.random.default_rng(dim)
    a = cap_links.unit(draw.standard_normal((2000, dim)))
    b = draw.standard_normal((2000, dim))
    b = cap_links.unit(b - (a * b).sum(1)[:, None] * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    same = np.zeros(len(a), np.int64)
    x, y = cap_links.filters_of(a, same, total), cap_links.filters_of(b, same, total)
    shared = np.array([len(np.intersect1d(p, q)) for p, q in zip(x, y)])
    assert (shared == 0).mean() <= 0.0005 and shared.mean() > 8


def test_filters_do_not_depend_on_the_batch():
    a = cap_links.unit(np.random.default_rng(0).standard_normal((97, 64)))
    same = np.zeros(97, np.int64)
    whole = cap_links.filters_of(a, same, 5000)
    alone = np.concatenate([cap_links.filters_of(a[k : k + 1], same[:1], 5000) for k in range(97)])
    assert (whole == alone).all()


def test_cap_links_query(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, QUERIES["op13_cap_links"](spark, FOLDER).collect()), key=str)
    assert got == brute_links(rows)
