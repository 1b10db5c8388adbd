"""Hard negatives against all pairs, and on odd rows."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, LABEL string"


def plain(rows, anchors, positives=5, negatives=10, least=30, most=90):
    """Every anchor against every row."""
    good = {i: (k, [math.floor(256 * x) for x in v]) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a in filter(anchors, good):
        label, own = good[a]
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=True)), i, k) for i, (k, v) in good.items() if i != a and len(v) == len(own))
        for p, i in [(-s, i) for s, i, k in scored if k == label][:positives]:
            found = [(j, -s) for s, j, k in scored if k != label and least * p <= -100 * s <= most * p][:negatives]
            out |= {(a, i, r, j, p, s) for r, (j, s) in enumerate(found, 1)}
    return out


def vectors(rng, n, size, labels):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.5) for x in c]
        norm = math.sqrt(sum(x * x for x in v))
        rows.append((i, rng.choice(labels), [x / norm for x in v]))
    return rows


@pytest.mark.parametrize(("size", "leaf"), [(3, 4), (16, 128), (1, 2)])
def test_negatives_equal_all_pairs(spark, size, leaf, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    rng = random.Random(size)
    rows = vectors(rng, 500, size, [0, 0, 0, 1, 2, 3]) + [(1000 + i, i % 3, [0.5] * size) for i in range(120)]  # copies: ties by id
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame, "vec_id % 20 = 0", part_rows=40, first=4).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, lambda i: i % 20 == 0)


def test_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (4, None, [0.5, 0.5]), (5, 2, None), (6, 2, [0.5, None]), (7, 2, [nan, 0.5]), (8, 2, [inf, 0.5]),
        (9, 2, [0.5]), (10, 2, []), (11, 1, [-1.0, 0.0]), (12, 2, [-0.5, 0.0]), (100, 3, [0.0, 1.0]), (200, 4, [1000.0, 1000.0]), (13, 4, [1000.0, 999.0]), (14, 5, [700.0, 700.0]),
        (300, 7, [-0.5, -0.25]), (15, 7, [0.5, 0.25]), (16, 8, [0.0, 0.0]), (17, 7, [0.0, 0.0]), (400, 9, []), (18, 9, []),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in [*rows, rows[1], (None, 1, [1.0, 1.0])]], SCHEMA)
    got = [tuple(r) for r in hard_negatives.hard_negatives(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, lambda i: i % 100 == 0)
    assert {g[3] for g in got if g[:2] == (0, 1)} == {2, 3, 15}
    assert hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boxes_bound_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (8, 4))
    whole = (centres[np.arange(4000) % 8] + rng.integers(-9, 9, (4000, 4))).astype(np.int64)
    tree = hard_negatives.Tree(np.arange(4000), np.arange(4000) % 8, whole)
    assert sorted(tree.ids.tolist()) == list(range(4000)) and (whole[tree.ids] == tree.whole).all()
    anchor = np.array([100.0, -50.0, 3.0, 7.0])
    low, high = tree.bounds(anchor[None])
    score = tree.vectors @ anchor
    for n in range(len(tree.start)):
        own = score[tree.start[n] : tree.end[n]]
        assert low[0, n] <= own.min() and own.max() <= high[0, n]
    opened = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                opened.append(len(at))
            return np.asarray(self)[at]

    tree.vectors = tree.vectors.view(Seen)
    (ids, scores), = tree.search(anchor, low[0], high[0], np.ones(len(tree.children), bool), np.array([[0, int(score.max()) - 100, hard_negatives.LOWEST]]), 10)
    window = np.flatnonzero((score >= 0) & (score <= score.max() - 100))
    best = window[np.lexsort((tree.ids[window], -score[window]))][:10]
    assert ids.tolist() == tree.ids[best].tolist() and scores.tolist() == score[best].astype(int).tolist()
    assert sum(opened) < 2600
