import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import hard_negatives


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, id int, anchor int, slot int")
    out = hard_negatives.mined(table, F.col("vec_id") % 100 == 0, F.col("label"), **options)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def brute(rows, positives=5, k=10, low=30, high=90):
    there = {
        (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)
    }
    out = []
    for i, label, a in there:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, other) for j, other, v in there if j != i)
        for minus, j, _ in [s for s in scored if s[2] == label][:positives]:
            near = [(-s, n) for s, n, other in scored if other != label and low * -minus <= 100 * -s <= high * -minus][:k]
            out += [(i, j, rank, n, -minus, s) for rank, (s, n) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"group_candidates": 70, "group_anchors": 2}, {"k": 3, "positives": 2, "low": 10, "high": 60, "group_candidates": 50}])
def test_equals_brute_force_with_copies_and_ties(spark, options):
    chance = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in chance.normal(0, 0.3, 8)], int(chance.integers(0, 4))) for i in range(900)]
    rows += [(2001 + i, rows[100][1], 1) for i in range(150)] + [(3000 + i, [float(round(x)) / 4 for x in chance.normal(0, 1, 8)], 2) for i in range(250)]
    got = mined(spark, rows, **options)
    assert got == brute(rows, **{n: v for n, v in options.items() if not n.startswith("group")}) and len(got) > 50


def test_small_blocks_of_scores(spark, monkeypatch):
    """Rows come in many small pieces; the kept ones are the same."""
    chance = np.random.default_rng(5)
    asked, there = chance.integers(-9, 10, (6, 4)).astype(float), chance.integers(-9, 10, (300, 4)).astype(float)
    ids, label = np.arange(300), chance.integers(0, 3, 300)
    limits = np.array([[60, 40, 10]] * 6)
    whole = hard_negatives.best_of_slots(asked, ids[:6], label[:6], limits, np.zeros(6, np.int64), there, ids, label, 4)
    monkeypatch.setattr(hard_negatives, "SCORES_AT_ONCE", 50)
    pieces = hard_negatives.best_of_slots(asked, ids[:6], label[:6], limits, np.zeros(6, np.int64), there, ids, label, 4)
    for name in ("lists", "scores", "ids"):
        assert getattr(whole, name).tolist() == getattr(pieces, name).tolist()


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, None, 2), (4, [None, 1.0], 2), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 1), (7, [0.4, 0.5], None),
        (None, [0.5, 0.5], 2), (8, [0.5], 2), (9, [], 2), (10, [0.5, 0.5], 2), (10, [0.5, 0.5], 2), (100, [-1.0, 0.0], 1), (200, [0.0, 0.0], 3), (201, [1.0, 1.0], 3), (202, [0.1, 0.1], 2),
        (300, [1.0, 0.0], 9), (400, [2.0, 2.0], 4), (401, [1.0, 1.0], 4), (402, [1.0, 1.0], 4),
    ]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {0, 200, 400}
    assert mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, []) == []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [1e7 + i, 3e6 - i, float(i)], i % 3) for i in range(0, 210)] + [(1000 + i, [4e6 + i, 1e6, 0.0], 5) for i in range(30)]
    got = mined(spark, rows)
    assert got == brute(rows) and got


def test_windows_overlap():
    """Rows of a lower slot fill up what a higher one leaves; a lower limit cuts them off."""
    kept = [(0, 85, 1), (0, 80, 2), (1, 60, 3), (1, 55, 4), (2, 20, 5)]
    out = list(hard_negatives.windows([(100, 7), (70, 8), (30, 9)], kept, 3, 30, 90))
    assert out == [(7, 100, 1, 1, 85), (7, 100, 2, 2, 80), (7, 100, 3, 3, 60), (8, 70, 1, 3, 60), (8, 70, 2, 4, 55), (9, 30, 1, 5, 20)]
