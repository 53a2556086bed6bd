import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallywork.functions import rewards as rw
from tallywork.operators import scoring

CORRECTNESS = [
    (r"</think>\boxed{}", "1", -0.5), (r"</think>\boxed{042}", "42", -1.0), (r"\boxed{42}", "42", 0.0),
    (r"</think>\boxed{42}", "42", 1.0), ("</think>```python", "1", 0.0), ("</think>", "1", -1.5), ("", "1", -1.5),
    (r"</think>\boxed{1}```python", "1", 0.0), (r"</think>\boxed{1}```python", "2", -2.0), (r"</think>oxed{1}", "1", -0.5),
]


def test_correctness(values):
    rows = [(c, a) for c, a, _ in CORRECTNESS]
    assert values(rows, "c string, a string", rw.correctness_reward("c", "a")) == [w for *_, w in CORRECTNESS]


def preference(length, preferred, scaling):
    x = length / preferred
    return min(math.e * x * math.exp(-x), 1.0) ** scaling


def test_format_reward(values):
    texts = ["a" * 100 + "\n\n" + "b" * 40 + "</think>```python", "\u3000abc\n\n\n\nd ", "</think>", ""]
    want = []
    for t in texts:
        parts = (t.split("</think>")[0].strip() if "</think>" in t else t).split("\n\n")
        top = 1 + sum(preference(len(p), 100, 0.9) * (len(p) + 100) for p in parts)
        valid = "</think>" in t and ("oxed{" in t) != ("```python" in t)
        want.append(top / (1 + sum(len(p) + 100 for p in parts)) - (not valid))
    assert values([(t,) for t in texts], "t string", rw.format_reward("t")) == pytest.approx(want)


def test_length_reward(values):
    text = "one two three</think> \\boxed{4}"
    got = values([(text,), ("x",)], "t string", rw.length_reward("t"))
    tokens = 3 + 4 + 5
    assert got == pytest.approx(
        [0.5 * preference(3, 246, 0.95) + 0.5 * preference(tokens, 256, 0.95), 0.5 * preference(1, 256, 0.95) - 1]
    )


def test_preference_is_at_most_one(values):
    lengths = [(float(i),) for i in (0, 1, 100, 256, 257, 1000, 100000)]
    got = values(lengths, "l double", rw.length_preference(F.col("l")))
    assert got[0] == 0 and got[3] == 1.0 and all(0 <= g <= 1 for g in got)


def test_weights(spark):
    calls = spark.range(0, 45).select(F.col("id").alias("call_idx"))
    got = {r.call_idx: r for r in scoring.weight_schedule(calls, 40).collect()}
    assert got[10].correctness_weight == 0 and got[40].correctness_weight == 0.75 == got[44].correctness_weight
    assert got[25].correctness_weight == pytest.approx(0.375)
    # Style uses the counter of the call before.
    for k in range(1, 45):
        assert got[k].style_weight == pytest.approx((1 - got[k - 1].correctness_weight) / 2)
    assert {r.correctness_weight for r in scoring.weight_schedule(calls, 0).collect()} == {0.75}


def test_advantages_sum_to_zero_with_one_large_group(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 else i, i, rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "question_id bigint, generation_id bigint, total_reward double")
    got = scoring.group_advantage(df)
    assert got.count() == 900
    sums = got.groupBy("question_id").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r.s) < 1e-9 for r in sums)


def test_reward_set_with_native_and_pandas_rewards(spark):
    @F.pandas_udf(DoubleType())
    def vowels(text: pd.Series) -> pd.Series:
        return text.str.count("[aeiou]").astype("float64")

    df = spark.createDataFrame([(1, "banana", "x"), (2, "", "")], "generation_id bigint, completion string, correct_answer string")
    rewards = scoring.RewardSet().add("length", rw.char_length_reward).add("vowels", vowels, weight=0.5)
    got = sorted(rewards.apply(df, ["generation_id"]).collect())
    assert [(r.length, r.vowels, r.total_reward) for r in got] == [(-94.0, 1.5, -92.5), (-100.0, 0.0, -100.0)]


def test_supplied_token_counts_are_used(spark):
    rows = [(1, 1, 1, "</think>\\boxed{1}", "1", 246, 256)]
    df = spark.createDataFrame(
        rows, "question_id bigint, generation_id bigint, call_idx bigint, completion string, correct_answer string, head int, size int"
    )
    got = scoring.score(df, 40, thinking=F.col("head"), tokens=F.col("size")).first()
    assert got.length_logged == pytest.approx(0.001) and got.correctness == 0 and got.correctness_logged == pytest.approx(0.001)
    parts = got.style + got.correctness + got.format_logged + got.length_logged + got.correctness_logged
    assert got.total_reward == pytest.approx(parts)


def test_weights_sum_to_one_at_equal_counters(spark):
    counters = spark.range(0, 60).select(
        (2 * rw.style_weight(F.col("id"), 40) + rw.correctness_weight(F.col("id"), 40)).alias("s")
    )
    assert all(r.s == pytest.approx(1.0) for r in counters.collect())


def test_plain_functions_are_bound_by_name(spark):
    """Functions as a trainer takes them: lists in, a list out, other columns by name."""

    def overlap(prompts, completions, **columns):
        assert set(columns) == {"correct_answer", "call_idx", "generation_id"} and len(columns["call_idx"]) == len(prompts)
        return [float(p in c) for p, c in zip(prompts, completions)]

    def exact(completions, correct_answer, tolerance=0.5):
        return [None if a is None else tolerance * (a == c) for c, a in zip(completions, correct_answer)]

    rows = [(i, i // 4, f"p{i % 3}", f"p{i % 2} said", "p0 said" if i % 5 else None) for i in range(40)]
    table = spark.createDataFrame(rows, "generation_id bigint, call_idx bigint, prompt string, completion string, correct_answer string").repartition(3)
    rewards = scoring.RewardSet().add("length", lambda c: F.length(c).cast("double")).add_function(overlap, weight=2.0).add_function(exact, name="same")
    for options in ({}, {"per_call": "call_idx"}):
        got = {r.generation_id: (r.length, r.overlap, r.same, r.total_reward) for r in rewards.apply(table, ["generation_id"], **options).collect()}
        for i, _, p, c, a in rows:
            same = None if a is None else 0.5 * (a == c)
            assert got[i] == (7.0, 2.0 * (p in c), same, 7.0 + 2.0 * (p in c) + (same or 0))


def test_a_function_over_whole_calls(spark):
    def rank(completions):
        return [sum(len(o) < len(c) for o in completions) for c in completions]

    table = spark.createDataFrame([(i, i % 7, "x" * (i // 7)) for i in range(70)], "generation_id bigint, call_idx bigint, completion string").repartition(5)
    got = scoring.RewardSet().add_function(rank).apply(table, ["generation_id", "call_idx"], per_call="call_idx").collect()
    assert {r.generation_id: r.rank for r in got} == {i: i // 7 for i in range(70)} and len(got) == 70


def test_functions_that_cannot_be_bound(spark):
    table = spark.createDataFrame([(1, "a")], "generation_id bigint, completion string")
    with pytest.raises(ValueError, match="correct"):
        scoring.RewardSet().add_function(lambda completions, correct: []).apply(table, ["generation_id"])
    with pytest.raises(TypeError, match="by name"):
        scoring.RewardSet().add_function(lambda *lists: [])
    with pytest.raises(Exception, match="gave 0 rewards for 1"):
        scoring.RewardSet().add_function(lambda completions: []).apply(table, ["generation_id"]).collect()
