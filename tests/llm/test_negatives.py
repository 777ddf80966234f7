"""Hard negatives: trees' bounds, brute force over mixed vectors, big numbers, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives, topk

SCHEMA = "vec_id long, embedding array<double>, label long, uid string, score string, tree string, window string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "u", "s", "t", "w") for r in rows], SCHEMA)


def brute(rows, anchor, low, high, scale, positives=5, negatives=5):
    """All answers by whole numbers of Python."""
    ok = [(i, [int(np.floor(scale * x)) for x in v], g) for i, v, g in rows if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q, g in ok:
        if not anchor(i):
            continue
        score = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j, h) for j, w, h in ok if j != i and len(w) == len(q))
        for s, j, h in [x for x in score if x[2] == g][:positives]:
            hard = [(t, k) for t, k, c in score if c != g and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, every, low=80, high=100, scale=256, **more):
    got = negatives.mine_hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, F.col("label"), low=low, high=high, scale=scale, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def some_rows(rng, n, dims=8):
    centers = rng.normal(size=(6, dims))
    rows = [(i, (centers[i % 6] + 0.4 * rng.normal(size=dims)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 3) for i in range(60)]  # copies: ties
    rows += [(n + 100 + i, np.abs(rng.normal(size=3)).tolist(), i % 2) for i in range(40)]  # another width
    return rows


@pytest.mark.parametrize("leaf", [4, 64])
def test_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(negatives, "LEAST_TREE_ROWS", 100)
    monkeypatch.setattr(negatives, "QUERIES_A_BLOCK", 7)
    monkeypatch.setattr(negatives, "LEAF", leaf)
    rows = some_rows(np.random.default_rng(1), 400)
    want = brute(rows, lambda i: i % 10 == 0, 80, 100, 256)
    assert len(want) > 300 and mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, low=20, high=130, negatives=2, positives=3) == brute(rows, lambda i: i % 10 == 0, 20, 130, 256, 3, 2)


def test_edges(spark):
    rng = np.random.default_rng(2)
    odd = [(None, [1.0, 1.0], 1), (0, None, 1), (5, [], 1), (10, [1.0, None], 1), (15, [1.0, float("nan")], 1), (20, [float("inf"), 1.0], 1), (25, [1.0, 1.0], None), (30, [0.0, 0.0], 1), (31, [0.0, 0.0], 1), (32, [0.0, 0.0], 2), (35, [-1.0, 1.0], 1), (36, [1.0, -1.0], 1), (40, [2.0], 3)]
    rows = odd + [(50 + i, rng.normal(size=2).tolist(), i % 3) for i in range(30)]
    assert mined(spark, rows, 5) == brute(rows, lambda i: i % 5 == 0, 80, 100, 256)
    assert mined(spark, [], 5) == []
    assert mined(spark, [(5, [1.0], 1)], 5) == []
    same = [(5, [1.0, 2.0], 1)] * 3 + [(6, [1.0, 2.0], 1)] * 2 + [(7, [1.0, 2.0], 2)] * 2  # repeated ids: three anchors, each with two positives of two negatives
    assert len(mined(spark, same, 5)) == 3 * 2 * 2


def test_scores_beyond_floats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(1 << 25, 1 << 26, 64).astype(float).tolist(), i % 3) for i in range(90)]
    want = brute(rows, lambda i: i % 9 == 0, 80, 100, 4)
    assert max(r[4] for r in want) > 1 << 53 and mined(spark, rows, 9, scale=4) == want
    ask = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 9 == 0, k=5, scale=4)
    whole = {i: [4 * int(x) for x in v] for i, v, _ in rows}
    for i in range(0, 90, 9):
        best = sorted((-sum(a * b for a, b in zip(whole[i], w, strict=True)), j) for j, w in whole.items() if j != i)[:5]
        assert [(r["vec_id"], r["score"]) for r in ask.filter(F.col("query_id") == i).orderBy("rank").collect()] == [(j, -s) for s, j in best]
    far = [(0, [1e300], 1), (1, [1e300], 1), (2, [1e300], 2), (3, [-1e300], 2)]
    assert mined(spark, far, 5) == [(0, 1, 1, 2, (1 << 63) - 1, (1 << 63) - 1)]


def test_trees_close_leaves(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centers[i % 40] + 0.05 * rng.normal(size=16)).tolist(), i % 80 // 40) for i in range(4000)]
    _, pairs = negatives.negatives_and_pairs(frame(spark, rows), F.col("vec_id") % 100 == 0, F.col("label"))
    count = {(r["pass"], r["opened"]): r["pairs"] for r in pairs.collect()}
    assert count["positives", False] == 40 * 4000 and 0 < count["positives", True] < 0.5 * 40 * 4000 and 0 < count["negatives", True] < 0.5 * 40 * 4000


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (700, 6))
    labels = rng.integers(0, 3, 700)
    tree = negatives.BallTree(np.arange(700), labels, x)
    q = rng.integers(-500, 500, (9, 6)).astype(float)
    everything = (np.full(9, -1e18), np.full(9, 1e18))
    leaves = tree.leaves(q, np.zeros(9, np.int64), *everything, same=False)
    assert sorted(r for a, b, *_ in leaves for r in range(a, b)) == list(range(700))
    for a, b, upper, lower, _ in leaves:
        own = q @ tree.x[a:b].T
        assert (own.max(1) <= upper).all() and (own.min(1) >= lower).all()
    assert sorted(map(tuple, tree.x.tolist())) == sorted(map(tuple, x.tolist()))
