"""Bounded top-k against all products."""

import numpy as np
import pytest

from kgspark.operators import vectors as V


def frame(spark, x, extra="", values=()):
    rows = [(i, [float(a) for a in v], *(col[i] for col in values)) for i, v in enumerate(x)] + [(99_999, None, *(col[0] for col in values))]
    return spark.createDataFrame(rows, "id long, embedding array<double>" + extra)


def clustered(seed, n, spread, centres=12, size=8):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(centres, size))[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, size))
    return np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 3)


def exact(q, b, k, mask=None):
    s = q @ b.T
    if mask is not None:
        s[mask] = -np.inf
    return {(i, int(j), r) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(b)), -s[i]))[:k], 1) if s[i, j] > -np.inf}


@pytest.mark.parametrize("spread, most", [(0.05, 0.5), (1.0, 1.0)])
def test_same_as_all_products_with_fewer_pairs(spark, spread, most):
    x = clustered(1, 900, spread)
    df = frame(spark, x)
    found, tried, all_ = V.bounded_top_k(df.where("id < 300").where("embedding IS NOT NULL"), df.where("embedding IS NOT NULL"), 5, V._product(5, False, None, False), block=32)
    got = {(r.query_id, r.cand_id, r["rank"]) for r in found.collect()}
    want = exact(x[:300], x, 5)
    assert len(got) == len(want) and len(got - want) <= 2  # products that differ in the last digit only may trade places
    assert tried <= most * all_


def test_the_large_way_is_taken_and_equal(spark, monkeypatch):
    x = clustered(2, 500, 0.2)
    at = list(range(500))
    df = frame(spark, x, ", at long, floor double", (at, [0.3] * 500))
    small = {(r.query_id, r.cand_id, r["rank"]) for r in V.top_k(df, df, 3, before=True).collect()}
    mine = {(r.query_id, r.cand_id, r["rank"]) for r in V.top_k(df, df, 4, self_score=-1.0).collect()}
    monkeypatch.setattr(V, "BLOCK", 40)
    monkeypatch.setattr(V, "ALL_PAIRS", 8)
    monkeypatch.setattr(V.bounded_top_k, "__defaults__", (None, False, 40))
    large = {(r.query_id, r.cand_id, r["rank"]) for r in V.top_k(df, df, 3, before=True).collect()}
    assert len(small) > 500 and len(large) == len(small) and len(large - small) <= 4
    again = {(r.query_id, r.cand_id, r["rank"]) for r in V.top_k(df, df, 4, self_score=-1.0).collect()}
    assert len(again) == len(mine) == 2000 and len(again - mine) <= 4


def test_lots_of_blocks_and_empty_stores(spark, monkeypatch):
    """Rows are copied once a lot, equal vectors tie by id, and many queries of an empty store find nothing."""
    x = np.repeat(clustered(3, 150, 0.3), 3, axis=0)
    df = frame(spark, x).where("embedding IS NOT NULL")
    monkeypatch.setattr(V, "BLOCK", 30)
    monkeypatch.setattr(V, "LOT", 90)
    got = {(r.query_id, r.cand_id, r["rank"]) for r in V.top_k(df, df, 4).collect()}
    sums = np.einsum("ik,jk->ij", x, x)
    assert len(got) == 1800
    for i in range(450):
        mine = sorted((rank, j) for q, j, rank in got if q == i)
        assert all(sums[i, a] > sums[i, b] - 1e-9 for (_, a), (_, b) in zip(mine, mine[1:]))
        same = [j for _, j in mine if j // 3 == mine[0][1] // 3]
        assert same == sorted(same) and len(same) == 3
    monkeypatch.setattr(V, "BLOCK", 2)
    none = df.where("id < 0")
    assert V.top_k(df, none, 4).count() == 0
    assert V.bounded_top_k(df, none, 4, V._product(4, False, None, False), block=8)[0].count() == 0
    assert V.top_k(none, df, 4).count() == 0


def test_sums_of_all_products(spark, monkeypatch):
    monkeypatch.setattr(V, "LOT", 7)
    monkeypatch.setattr(V, "TILE", (3, 2))
    x = clustered(4, 60, 0.5)
    rows = [(i % 3 if i % 10 else None, [float(a) for a in v]) for i, v in enumerate(x)] + [(1, None), (9, [1.0] * 8)]
    df = spark.createDataFrame(rows, "label int, embedding array<double>")
    got = {r.label: r for r in V.product_sums(df, df.where("label < 9"), "label").collect()}
    assert set(got) == {0, 1, 2}
    for label, r in got.items():
        own = np.array([v for k, v in rows if k == label and v is not None])
        s = own @ own.T
        assert r.pairs == (len(own) + (label == 1)) ** 2 and abs(r["mean"] - s.mean()) < 1e-9 and abs(r.most - s.max()) < 1e-9


def test_index_search_in_lots(spark, monkeypatch):
    monkeypatch.setattr(V, "LOT", 40)
    x = clustered(5, 300, 0.4)
    df = frame(spark, x)
    index = V.CellIndex(df.where("embedding IS NOT NULL"), cells=3)
    got = {(r.query_id, r.cand_id, r["rank"]) for r in index.search(df.where("id < 50"), 5, 3).collect()}
    assert len(got) == 250 and len(got - exact(x[:50], x, 5)) <= 2


@pytest.mark.parametrize("kind", ["plain", "exclude", "self", "before"])
def test_repeated_vectors_are_multiplied_once(spark, monkeypatch, kind):
    """Of many equal vectors few are multiplied, and ids and ranks are those of all products."""
    x = clustered(6, 12, 0.5)[np.random.default_rng(6).integers(0, 12, 400)]
    options = {"plain": {}, "exclude": {"exclude_self": True}, "self": {"self_score": -1.0}, "before": {"before": True}}[kind]
    df = frame(spark, x, ", at long, floor double", (list(range(400)), [0.2] * 400)) if kind == "before" else frame(spark, x)
    sizes = []
    blocks = V._blocks
    monkeypatch.setattr(V, "_blocks", lambda d, c, n: sizes.append(d.count()) or blocks(d, c, n))
    got = {(r.query_id, r.cand_id, r["rank"]) for r in V.top_k(df, df, 3, **options).collect()}
    assert min(sizes) <= 12 * 4
    monkeypatch.setattr(V, "REPEATED", 0.0)
    assert got == {(r.query_id, r.cand_id, r["rank"]) for r in V.top_k(df, df, 3, **options).collect()}
    assert len(got) > 1000


def test_few_lots_while_they_fit(spark):
    """Up to eight lots of what a task can hold, a row is copied eight times and not more as rows grow."""
    x = np.random.default_rng(7).normal(size=(32, 64))
    assert V._near_blocks(frame(spark, x).where("embedding IS NOT NULL"), x, 16_384)[1:] == (32, 8)
