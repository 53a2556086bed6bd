import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import block_topk


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, score int, rank int, id int".replace("label int, ", ""))


def whole(vector):
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def brute(rows, k=5):
    usable = {(i, tuple(whole(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)}
    out = []
    for i, q in usable:
        if i % 50:
            continue
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in usable if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, **options):
    out = block_topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("options", [{}, {"group_candidates": 60, "group_queries": 3}])
def test_equals_brute_force_with_copies_and_ties(spark, options):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(-50, rows[3][1]), (2050, rows[3][1])]
    rows += [(3000 + i, [float(round(x)) / 4 for x in rng.normal(0, 1, 8)]) for i in range(200)]
    assert found(spark, rows, **options) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 0.0]), (None, [5.0, 5.0]), (1, [1.0]), (2, []), (3, [0.0, 0.0, 9.0]),
        (0, [1.0, 2.0]), (4, [-0.0, -0.001]), (250, [0.5, 0.5]), (5, [1.0, 2.0]), (5, [1.0, 2.0]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [1e7 + i, 3e6 - i, float(i)]) for i in range(0, 120)]
    assert found(spark, rows) == brute(rows)
    huge = [(i, [1e25 * (i + 1), -1e20, 1.0]) for i in range(0, 60)]
    assert found(spark, huge) == brute(huge)


def test_blocks_are_pruned(monkeypatch):
    """Clustered vectors: most blocks are never scored."""
    rng = np.random.default_rng(1)
    centres = rng.choice([-200, 200], (32, 16))
    vectors = np.concatenate([c + rng.integers(-20, 20, (200, 16)) for c in centres]).astype(float)
    ids = np.arange(len(vectors))
    seen = []
    kept = block_topk.kept_best
    monkeypatch.setattr(block_topk, "kept_best", lambda q, s, i, k: seen.append(len(q)) or kept(q, s, i, k))
    q, s, c = block_topk.search(ids[:40], vectors[:40], ids, vectors, 5)
    exact = vectors[:40] @ vectors.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    for i in range(40):
        order = sorted(range(len(ids)), key=lambda j: (-exact[i, j], j))[:5]
        assert c[q == i].tolist() == order
    assert len(seen) < 6
