"""Top-k search and hard negatives against brute force; brackets and bounds against exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bargainry.llm import ball_tree, pivots, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, q string, dim string, shard int"


def brute(rows, scale):
    out = []
    for id, vec, label in rows:
        if vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            out.append((id, tuple(math.floor(scale * float(np.float32(x))) for x in vec), label))
    return out


def first(rows, k):
    """Of (score, id): higher scores first, then smaller ids, none last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]


def top_k(rows, k=10, scale=1024):
    rows = brute(rows, scale)
    out = []
    for id, vec in sorted({(i, v) for i, v, _ in rows if i is not None and i % 100 == 0}):
        near = first([(int(np.dot(vec, v)), i) for i, v, _ in rows if i != id and len(v) == len(vec)], k)
        out += [(id, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return sorted(out, key=str)


def mined(rows, k=5, scale=256):
    rows = [r for r in brute(rows, scale) if r[2] is not None]
    out = []
    for id, vec, label in sorted({r for r in rows if r[0] is not None and r[0] % 100 == 0}):
        others = [(int(np.dot(vec, v)), i, la) for i, v, la in rows if i != id and len(v) == len(vec)]
        for p, pid in first([(s, i) for s, i, la in others if la == label], k):
            hard = first([(s, i) for s, i, la in others if la != label and 80 * p <= 100 * s <= 100 * p], k)
            out += [(id, pid, n + 1, i, p, s) for n, (s, i) in enumerate(hard)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], SCHEMA)


def awkward(n, seed=1):
    """Clusters, copies of one vector on a third of the rows, ties, repeated rows and ids, nulls, other lengths."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.randrange(5)
        vec = centres[0] if i % 3 == 0 else [round(x + rng.gauss(0, 0.05), 2) for x in centres[c]]
        rows.append((i, vec, rng.choice([c, c, c, 7])))
    rows += rows[:3] + rows[100:102] + [rows[200]] * 4
    rows += [(300, centres[1], 1), (300, centres[2], 2), (None, centres[1], 1), (None, centres[0], 0), (None, centres[2], None)]
    rows += [(400, None, 1), (401, [], 1), (402, [], 1), (500, [], 2), (600, [None] * 6, 1), (601, [float("nan")] * 6, 1), (602, [float("inf")] + [0.0] * 5, 1)]
    rows += [(700, [0.0] * 6, 1), (701, [-0.1] * 6, 3), (800, [0.5, 0.25], 1), (801, [0.5, 0.25], 1), (802, [0.5, 0.24], 2), (0, [0.0] * 6, None), (-100, centres[3], 3)]
    rows += [(900, [3e4, -2e4], 4), (901, [2e4, 1e4], 4), (902, [1.7e4, 1e4], 5), (-7, [1.0, 1.0], 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [40, vectors.SHARD_ROWS])
def test_top_k(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(ball_tree, "LEAF", 16)
    rows = awkward(700)
    got = ball_tree.top_k(table(spark, rows), F.col("vec_id") % 100 == 0, shard_rows=shard_rows)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == top_k(rows)


@pytest.mark.parametrize("shard_rows", [40, vectors.SHARD_ROWS])
def test_mine(spark, shard_rows):
    rows = awkward(700, 2)
    got = pivots.mine(table(spark, rows), F.col("vec_id") % 100 == 0, F.col("label"), shard_rows=shard_rows)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    want = mined(rows)
    assert len(want) > 100 and sorted(map(tuple, got.collect()), key=str) == want


def test_empty_and_too_few(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, None, 1), (200, [None], 2)]):
        df = table(spark, rows)
        assert ball_tree.top_k(df, F.col("vec_id") % 100 == 0).count() == 0
        assert pivots.mine(df, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def probed(kind, vec, label, asks, floors, caps, k):
    order, more, head = kind.arrange(vec, label)
    rows = {"vec": vec, "id": np.arange(len(vec)), "none": np.zeros(len(vec), bool), "label": label, "rank": np.arange(len(vec))}
    index = kind(head, [{k: v[order] for k, v in rows.items()} | more])
    block = vectors.Block(k, index, {"vec": asks, "label": np.full(len(asks), -1), "id": np.full(len(asks), -1), "floors": floors, "caps": caps})
    offered = []
    keep = block.offer
    block.offer = lambda a, r, s: (offered.append(len(a)), keep(a, r, s))
    index.probe(block)
    return block, sum(offered), index


def test_the_tree_leaves_most_of_clustered_rows_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (40, 16))
    vec = np.rint(centres[rng.integers(0, 40, 20000)] + rng.normal(0, 20, (20000, 16))).astype(np.int64)
    asks = vec[:50]
    looked = []
    products, ball_tree.products = ball_tree.products, lambda a, b: (looked.append(len(a) * len(b)), vectors.products(a, b))[1]
    try:
        block, _, index = probed(ball_tree.BallTree, vec, np.zeros(20000, int), asks, np.full((50, 1), vectors.LOW), np.full((50, 1), vectors.HIGH), 10)
    finally:
        ball_tree.products = products
    assert sum(looked) < 0.2 * 50 * 20000
    exact = asks @ vec.T
    for i in range(50):
        want = sorted(range(20000), key=lambda r: (-exact[i, r], r))[:10]
        assert index.rows["id"][block.row[i]].tolist() == want
    looked.clear()
    probed(ball_tree.BallTree, vec, np.zeros(20000, int), asks, block.score[:, -1:].copy(), np.full((50, 1), vectors.HIGH), 10)
    assert sum(looked) <= 0.2 * 50 * 20000  # a score that is known leaves no more to do


def test_brackets_hold_every_score_and_leave_rows_out():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (30, 16))
    vec = np.rint(centres[rng.integers(0, 30, 6000)] + rng.normal(0, 6, (6000, 16))).astype(np.int64)
    asks = vec[:40]
    exact = asks @ vec.T
    caps = np.sort(exact, axis=1)[:, -100:-99].copy()
    block, offered, index = probed(pivots.PivotTable, vec, np.zeros(6000, int), asks, (0.8 * caps).astype(np.int64), caps, 5)
    real, squares = asks.astype(float), (asks.astype(float) ** 2).sum(axis=1)
    pivot = index.head["pivots"]
    away = np.sqrt(np.maximum(0, squares[:, None] + (pivot**2).sum(axis=1) - 2 * real @ pivot[:, :-1].T))
    low, high = index.bracket(away, index.rows["away"], index.rows["away"], squares)
    scores = exact[:, index.rows["id"]]
    assert (low <= scores).all() and (scores <= high).all()
    assert ((high < 0.8 * caps) | (low > caps)).mean() > 0.3
    for i in range(40):
        fit = [r for r in range(6000) if 0.8 * caps[i, 0] // 1 <= exact[i, r] <= caps[i, 0]]
        assert index.rows["id"][block.row[i]].tolist() == sorted(fit, key=lambda r: (-exact[i, r], r))[:5]


def test_products_of_large_numbers():
    a = np.array([[1 << 30, 3], [-(1 << 29), 7]])
    b = np.array([[1 << 31, 5], [(1 << 31) + 1, 1]])
    assert vectors.products(a, b).tolist() == [[int(x) * int(p) + int(y) * int(q) for p, q in b] for x, y in a]
    assert vectors.narrow(np.array([1, -5])).dtype == np.int16 and vectors.narrow(b).dtype == np.int64
