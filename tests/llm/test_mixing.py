from collections import defaultdict

import pytest
from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from tallywork.llm import mixing

def tree():
    return {"domain": F.col("lang"), "source": F.col("source")}


def water(children, budget):
    """Shares by filling all in proportion, one full child at a time."""
    out, open_ = {}, {k: v for k, v in children.items() if v[0] > 0 and v[1] > 0}
    while open_:
        weight = sum(w for _, w in open_.values())
        full = [k for k, (room, w) in open_.items() if room * weight <= budget * w]
        if not full:
            return out | {k: int(budget / weight * w) for k, (_, w) in open_.items()}
        first = min(full, key=lambda k: open_[k][0] / open_[k][1])
        out[first] = open_[first][0]
        budget -= open_.pop(first)[0]
    return out


def budgets(spark, leaves, budget, weights, most):
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "a string, b string, tokens long")
    return {(r.a, r.b): r.budget for r in mixing.leaf_budgets(df, ["a", "b"], budget, weights, most).collect()}


@pytest.mark.parametrize("budget,most", [(100, 1), (700, 1), (1500, 1), (1500, 2), (10_000, 3)])
def test_shortages_go_to_siblings_first(spark, budget, most):
    leaves = {("w", "x"): 100, ("w", "y"): 900, ("b", "x"): 50, ("b", "z"): 20, ("c", None): 400, (None, "q"): 7, ("d", "x"): 30}
    weights = {("w",): 5, ("b",): 4, ("w", "x"): 9, ("b", "z"): 3, ("d",): 0}
    found = budgets(spark, leaves, budget, weights, most)
    top = water({a: (sum(t * most for k, t in leaves.items() if k[0] == a), weights.get((a,), 1)) for a in {k[0] for k in leaves}}, budget)
    expected = {}
    for a, share in top.items():
        for k, v in water({k: (t * most, weights.get(k, 1)) for k, t in leaves.items() if k[0] == a}, share).items():
            expected[k] = v
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) <= 1 for k in found)


def test_a_short_leaf_does_not_move_its_parent(spark):
    leaves = {("w", "x"): 10, ("w", "y"): 1000, ("b", "x"): 1000}
    found = budgets(spark, leaves, 600, {}, 1)
    assert found == {("w", "x"): 10, ("w", "y"): 290, ("b", "x"): 300}
    assert budgets(spark, leaves | {("w", "y"): 100}, 600, {}, 1) == {("w", "x"): 10, ("w", "y"): 100, ("b", "x"): 490}


def test_prefixes_and_epochs(spark):
    rows = awkward(spark) + [(1000 + i, prose(i, 5 + i % 50), "en" if i % 3 else "fr", f"src{i % 4}") for i in range(400)]
    docs = documents(spark, rows)
    out = mixing.mixed(docs, tree(), 3000, {("fr",): 30}, most_epochs=3, seed=3)
    assert out.columns == [*docs.columns, "_epoch"]
    picked = defaultdict(list)
    for r in out.select("doc_id", "lang", "source", "text", "_epoch").collect():
        picked[r.lang, r.source, r["_epoch"]].append(r)
    sizes = {}
    for _, text, lang, source in rows:
        sizes[lang, source] = sizes.get((lang, source), 0) + len((text or "").split())
    total = 0
    for (lang, source, epoch), chosen in picked.items():
        tokens = sum(len((r.text or "").split()) for r in chosen)
        total += tokens
        later = any(k[:2] == (lang, source) and k[2] > epoch for k in picked)
        assert tokens == sizes[lang, source] if later else tokens <= sizes[lang, source]
    assert 2000 <= total <= 3000
    assert max(e for *_, e in picked) >= 1
    again = mixing.mixed(docs, tree(), 3000, {("fr",): 30}, most_epochs=3, seed=3)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


@pytest.mark.parametrize("digits", [1, 3])
def test_prefix_is_that_of_the_sorted_leaf(spark, monkeypatch, digits):
    monkeypatch.setattr(mixing, "BUCKET_DIGITS", digits)
    rows = [(i, prose(i, 1 + i % 30), "en", "s") for i in range(300)] + [(5, prose(5, 6), "en", "s")]
    docs = documents(spark, rows, extra=False)
    chosen = sorted(r.doc_id for r in mixing.mixed(docs, tree(), 0.37, {}, seed=9).collect())
    places = docs.select("doc_id", F.size(F.split("text", " ")).alias("n"), mixing.seeded(F.col("doc_id"), 9, F.lit(0)).alias("p")).collect()
    budget = int(sum(r.n for r in places) * 0.37)
    expected = [r.doc_id for r in places if sum(q.n for q in places if q.p <= r.p) <= budget]
    assert chosen == sorted(expected)


def test_empty_table_and_python_free_plan(spark):
    assert mixing.mixed(documents(spark, []), tree(), 0.5, {}).count() == 0
    plan = mixing.mixed(documents(spark, awkward(spark)), tree(), 0.5, {})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
