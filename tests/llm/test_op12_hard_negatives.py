import math
import random

import numpy as np
import pytest

from gazette.llm.op12_hard_negatives import RTree, hard_negatives, search

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows):
    ok = []
    for i, x, label, _ in rows:
        if label is not None and x and all(c is not None and math.isfinite(c) for c in x):
            ok.append((i, [math.floor(256 * float(np.float32(c))) for c in x], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (i, x, label) in enumerate(ok):
        if i is None or i % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), last(j), j, own) for b, (j, y, own) in enumerate(ok) if b != a and len(y) == len(x)]
        scored.sort(key=lambda s: s[:2])
        for p in [s for s in scored if s[3] == label][:5]:
            inside = [s for s in scored if s[3] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(i, p[2], n + 1, s[2], -p[0], -s[0]) for n, s in enumerate(inside)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def vectors(seed, n, dims=6, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        x = [round(c + rng.gauss(0, 0.3), rng.choice([1, 3])) for c in rng.choice(centres)]
        rows.append((i, x, rng.randrange(labels), "x"))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"slab": 40, "group": 3}])
def test_brute_force(spark, sizes):
    rows = vectors(1, 420)
    rows += rows[100:103] + [(500, [1.0] * 6, 1, "x"), (550, [1.0] * 6, None, "x"), (600, None, 1, "x"), (650, [1.0, None] * 3, 1, "x"), (700, [1.0, float("nan")] * 3, 1, "x"), (750, [float("inf")] * 6, 1, "x"), (800, [], 2, "x")]
    rows += [(None, [0.5] * 6, 2, "x"), (None, [0.5] * 6, 2, "x"), (850, [1.0, 2.0], 3, "x"), (851, [1.0, 1.9], 3, "x"), (852, [1.0, 1.5], 2, "x"), (900, [-1.0] * 6, 1, "x"), (950, [0.0] * 6, 1, "x")]
    want = brute(rows)
    assert len(want) > 60
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA), **sizes)) == want


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0], i % 3, "x") for i in range(120)] + [(200 + i, [0.6, 1.3, 1.8 - i / 1000], i % 3, "x") for i in range(120)]
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA), slab=32, group=2)) == brute(rows)


def test_empty_and_alone(spark):
    assert got(hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert got(hard_negatives(spark.createDataFrame([(50, [1.0, 2.0], 1, "x")], SCHEMA))) == []


def test_large_components(spark):
    rows = [(50, [3e6, 1.0], 1, "x"), (51, [3e6, 2.0], 1, "x"), (52, [2e6, 2.0], 2, "x")]
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows) != []


def test_intervals_hold_all_products_and_boxes_are_pruned():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-40, 40, (500, 8)), rng.integers(200, 260, (500, 8))])
    tree = RTree(v, 16, 4)
    anchors = rng.integers(-100, 100, (20, 8))
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            low, high = tree.interval(anchors, [node])
            s = anchors @ v[rows].T
            assert (s >= low).all() and (s <= high).all()
    assert sorted(np.concatenate([r for r in tree.rows if r is not None])) == list(range(1000))
    asked = []
    may = lambda a, r: asked.append(len(a) * len(r)) or np.ones((len(a), len(r)), bool)
    one = np.full((1, 8), 50)
    top = (v @ one[0]).max()
    list(search(tree, v, np.arange(1000), may, one, np.array([[0]]), np.array([[top]]), 3))
    assert sum(asked) < 500
