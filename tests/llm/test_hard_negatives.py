"""Cover trees and mined negatives against comparisons of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm.common import pin_batches
from tickerloom.llm.cover_tree import CoverTree
from tickerloom.llm.hard_negatives import Mining, mine


def _clusters(rng, clusters, each, dims, spread):
    centres = rng.normal(size=(clusters, dims)) * 200
    return np.floor(np.repeat(centres, each, axis=0) + rng.normal(size=(clusters * each, dims)) * spread).astype(np.int64)


@pytest.mark.parametrize("spread", [0, 3, 60, 400])
@pytest.mark.parametrize("scale", [1, 10**6])
def test_search(spread, scale):
    rng = np.random.default_rng(spread)
    points = _clusters(rng, 20, 60, 8, spread) * scale
    points[:5] = 0
    ids, labels = rng.permutation(len(points)), rng.integers(0, 4, len(points))
    tree = CoverTree(points, ids, labels, leaf=10)
    exact = points.astype(object)
    for at in rng.choice(len(points), 25):
        q = points[at]
        scores = exact @ q.astype(object)
        top = int(scores.max())
        low, high = [-math.inf, top // 2, top // 10, 5], [math.inf, top * 95 // 100, top // 5, 4]
        for same in (True, False):
            got, _ = tree.search(q, labels[at], same, low, high, 3)
            for a, b, found in zip(low, high, got, strict=True):
                fits = [(-s, i) for s, i, y in zip(scores, ids, labels, strict=True) if (y == labels[at]) == same and a <= s <= b]
                assert [(-s, i) for s, i in found] == sorted(fits)[:3]


def test_tree_holds_its_invariants_and_skips():
    rng = np.random.default_rng(3)
    points = _clusters(rng, 40, 100, 16, 4)
    tree = CoverTree(points, np.arange(len(points)), np.arange(len(points)) % 2, leaf=10)
    lifted = np.hstack([tree.points, np.sqrt(tree.top - (tree.points.astype(float) ** 2).sum(1))[:, None]])
    middle = np.hstack([tree.centres, np.sqrt(tree.top - (tree.centres.astype(float) ** 2).sum(1))[:, None]])
    for n in range(len(tree.start)):
        away = np.linalg.norm(lifted[tree.start[n] : tree.stop[n]] - middle[n], axis=1)
        assert away.max() <= tree.radius[n] and away.min() <= tree.blur
        below = range(tree.child[n], tree.child[n] + tree.children[n])
        if below:
            assert [tree.start[below[0]], *(tree.stop[c] for c in below)] == [*(tree.start[c] for c in below), tree.stop[n]]
            gaps = [np.linalg.norm(middle[a] - middle[b]) for a in below for b in below if a < b]
            # Separated: farther apart than any child reaches.
            assert min(gaps) >= max(tree.radius[c] for c in below) - 2 * tree.blur
    compared = sum(tree.search(q, 0, True, [-math.inf], [math.inf], 5)[1] for q in points[::50])
    # Products with centres count too.
    assert compared < 0.15 * len(points) * len(points[::50])


def _brute(rows, mining):
    rows = [(i, y, np.floor(np.array(v, float) * mining.scale).astype(np.int64)) for i, y, v in rows]
    distinct = {(i, y, tuple(v)): v for i, y, v in rows}
    rows = [(i, y, v) for (i, y, _), v in distinct.items()]
    out = set()
    for n, (anchor, label, vec) in enumerate(rows):
        if anchor % mining.every:
            continue

        def score(v):
            k = min(len(v), len(vec))
            return int(v[:k] @ vec[:k])

        scored = [(-score(v), i, y) for m, (i, y, v) in enumerate(rows) if m != n]
        positives = sorted((s, i) for s, i, y in scored if y == label)[: mining.positives]
        for ps, positive in positives:
            fits = sorted((s, i) for s, i, y in scored if y != label and mining.low * -ps <= 100 * -s <= mining.high * -ps)
            out |= {(anchor, positive, k, i, -ps, -s) for k, (s, i) in enumerate(fits[: mining.negatives], 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"tree_bytes": 8 * 8 * 64, "query_bytes": 1}])
def test_mine(spark, sizes):
    pin_batches(spark)
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 4)), (rng.normal(size=8) / 2).tolist()) for i in range(400)]
    same = rows[100][2]
    rows += [(1000 + 10 * i, i % 2, same) for i in range(200)]  # a third of the rows, and of the anchors, are alike
    rows += [(50, rows[50][1], rows[50][2])] * 3 + [(5000, 1, [1.0, 0.5]), (5050, 2, []), (5100, 9, [0.0] * 8), (-50, 3, rows[7][2])]
    odd = [(None, 1, same), (6000, None, same), (6050, 1, None), (6100, 1, [float("nan")] * 8), (6150, 2, [float("inf")] * 8), (6200, 1, [None] * 8)]
    embeds = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").repartition(4)
    for clash in ("id", "vec", "score", "block", "query", "n", "positives"):
        embeds = embeds.withColumn(clash, F.lit("x"))
    mining = Mining(**sizes)
    rows = [(i, y, np.array(v, np.float32)) for i, y, v in rows]
    got = [tuple(r) for r in mine(embeds, mining).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows, mining)
    assert mine(embeds.limit(0)).count() == 0


def test_very_large_components(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, [rng.choice([-1, 1]) * rng.random() * 2.0**20 for _ in range(6)]) for i in range(200)]
    embeds = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in mine(embeds).collect()} == _brute(rows, Mining())
    huge = spark.createDataFrame([(0, 1, [1e300, 1.0]), (1, 1, [1e300, 2.0]), (2, 2, [1e299, 1.0])], "vec_id long, label int, embedding array<double>")
    assert [tuple(r)[:2] for r in mine(huge).collect()] == []
