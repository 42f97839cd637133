"""Negatives against all pairs, with zone maps of every size; the curve against its definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import hard_negatives as H

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, every):
    """Rows (anchor, positive, rank, negative, scores) by the definition, in whole numbers."""
    fit = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for at, (i, a, label) in enumerate(fit):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, other == label) for k, (j, b, other) in enumerate(fit) if k != at]
        scored.sort()
        for ps, j, _ in [s for s in scored if s[2]][:5]:
            window = [(n, k) for n, k, same in scored if not same and -50 * ps <= -100 * n <= -95 * ps]
            found += [(i, j, r, k, -ps, -n) for r, (n, k) in enumerate(window[:3], 1)]
    return sorted(found)


def some_rows(seed, n, width=6, labels=4):
    """Groups of near vectors with mixed labels, lone vectors, copies and repeated ids."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    vectors = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, width)) * 0.3
    vectors[: n // 4] = rng.normal(size=(n // 4, width))
    vectors[n // 2 : n // 2 + 9] = vectors[0]
    return [(int(i), v.tolist(), int(k)) for i, v, k in zip(rng.permutation(n), vectors, rng.integers(0, labels, n))]


def collected(spark, rows, every):
    table = spark.createDataFrame(rows, SHAPE)
    found = H.hard_negatives(table, F.col("vec_id") % every == 0)
    assert found.columns == [c.split()[0] for c in H._RESULT.split(", ")]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("block, bundle, chunk, seeds", [(1024, 4096, 8192, 2), (8, 5, 7, 1), (16, 9, 4, 3)])
def test_against_all_pairs(spark, monkeypatch, block, bundle, chunk, seeds):
    for name, value in (("BLOCK", block), ("BUNDLE", bundle), ("CHUNK", chunk), ("SEEDS", seeds)):
        monkeypatch.setattr(H, name, value)
    rows = some_rows(block, 260)
    assert collected(spark, rows, 7) == brute(rows, 7)


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 8)
    asked = []
    staged = H.staged
    monkeypatch.setattr(H, "staged", lambda df, name: asked.append((name, staged(df, name))) or asked[-1][1])
    rng = np.random.default_rng(0)
    centres = np.eye(8) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.05).tolist(), i % 8 // 4) for i in range(640)]
    assert collected(spark, rows, 10) == brute(rows, 10)
    read = [t.count() for name, t in asked if name == "negatives-asked"]
    assert read[0] < 0.2 * 64 * 80 and read[2] < 0.5 * 64 * 80


def test_rows_that_take_no_part_and_odd_ones(spark):
    inf = float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [0.9, 0.9], 1), (2, [0.5, 0.9], 2), (3, [0.7, 0.7], 3),
        (4, [0.7, 0.7], 3), (5, None, 1), (6, [1.0, None], 1), (7, [1.0, inf], 2), (8, [1.0, float("nan")], 2),
        (9, [1.0, 1.0], None), (10, [-1.0, 0.2], 1), (20, [0.0, 0.0], 4), (21, [0.0, 0.0], 4), (22, [0.3, 0.3], 1),
        (None, [1.0, 1.0], 1),
    ]
    assert collected(spark, rows, 10) == brute(rows, 10) != []


def test_huge_numbers_and_short_vectors(spark):
    rows = [(0, [1e13], 1), (1, [1.0, 5.0], 1), (2, [0.7], 2), (3, [0.6, 0.0, 9.0], 2), (4, [-1e13], 2)]
    padded = [(i, v + [0.0] * (3 - len(v)), label) for i, v, label in rows]
    assert collected(spark, rows, 50) == brute(padded, 50) != []
    # Beyond 64 bits all scores are alike, so no negative is below 95 % of the positive.
    assert collected(spark, [(0, [1e300], 1), *rows[1:]], 50) == []


def test_no_rows_no_anchors_and_clashing_columns(spark):
    assert collected(spark, [], 2) == []
    rows = some_rows(3, 40)
    assert collected(spark, [(i + 1000, *r) for i, r in ((i, r[1:]) for i, r in enumerate(rows))], 5000) == []
    table = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as anchor", "2 as block", "3 as vector", "4 as rank", "5 as score")
    found = H.hard_negatives(table, F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5)


@pytest.mark.parametrize("axes, bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = [bytes(k) for k in H.hilbert_keys(grid, bits)]
    assert len(set(keys)) == len(grid)
    walk = grid[np.argsort(np.array(keys, dtype=f"S{len(keys[0])}").view(np.uint8).reshape(len(keys), -1)
                           .dot(256 ** np.arange(len(keys[0]))[::-1].astype(object)))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("seed", range(3))
def test_scores_lie_within_their_bounds(seed):
    rng = np.random.default_rng(seed)
    anchors, rows = rng.integers(-300, 300, (20, 7)).astype(float), rng.integers(-300, 300, (50, 7)).astype(float)
    low, high = H._bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = H._products(anchors, rows)
    assert (low <= scores).all() and (scores <= high).all()
