"""Votes against hand-derived values and a plain Python count."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallywork.functions.answers import answer_value, floor_mod
from tallywork.operators import votes
from tallywork.operators.ranking import grouped_positions

SCHEMA = "question_id bigint, generation_id bigint, method string, arrival bigint, answer string"


def answers_of(spark, cases):
    rows = [(q, q * 1000 + i, "math", i, a) for q, answers in enumerate(cases) for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, SCHEMA)


def test_majority(spark):
    cases = [["0", "0", "7"], ["-5"], ["1005", "5", "5"], ["0"], ["x"], ["3", "4"], ["0", "-5", "0"]]
    got = {r.question_id: r.answer for r in votes.majority_answer(answers_of(spark, cases)).collect()}
    assert got == {0: 7, 1: 995, 2: 5, 3: 0, 4: None, 5: 4, 6: 0}
    questions = spark.range(8).withColumnRenamed("id", "question_id")
    predicted = {r.question_id: r.answer for r in votes.predict_table(questions, answers_of(spark, cases)).collect()}
    assert predicted[4] == predicted[7] == 210 and predicted[0] == 7


def test_early_answer(spark):
    cases = [
        ["3", "3"], ["3", "3", "4"], ["0", "0"], ["0", "0", "0"], ["3"] * 3 + ["4"], ["3"] * 3 + ["4"] * 2,
        ["3"] * 4 + ["4"] * 3, ["3"] * 4 + ["4"] * 4, ["3"] * 5 + ["4"] * 5, ["x", "x"], [" 3", "+3"],
    ]
    got = {r.question_id: r.stop for r in votes.early_answer(answers_of(spark, cases)).collect()}
    assert [got[i] for i in range(len(cases))] == [
        True, False, False, True, True, False, True, False, True, False, True,
    ]
    batch = votes.early_answer(answers_of(spark, [["3"] * 15, ["3"] * 16]), full_agreement=16)
    assert {r.question_id: r.stop for r in batch.collect()} == {0: False, 1: True}


def number(answer):
    try:
        return int(answer) if int(answer) == float(answer) else None
    except ValueError:
        return None


def brute_winner(answers):
    count = Counter(v for v in map(number, answers) if v is not None)
    weight = {v: c if v == 0 else 2 * c for v, c in count.items()}
    return max(((w, v) for v, w in weight.items()), default=(None, None))[1]


def brute_stop(rows, deadline, poll=20):
    """rows of one question: (method, arrival, answer)."""

    def agreed(answers):
        count = Counter(v for v in map(number, answers) if v is not None)
        f = sorted([(c + 1) // 2 if v == 0 else c for v, c in count.items()] + [0, 0, 0])[::-1]
        return bool(count) and (
            (f[0] >= 2 and f[1] <= 0) or (f[0] >= 3 and f[1] <= 1) or (f[0] >= 4 and f[1] <= 3) or f[0] >= 5
        )

    tick = 0
    while True:
        if tick * poll > deadline:
            reason = "deadline"
            break
        tick += 1
        seen = [(m, a) for m, t, a in rows if t <= tick * poll]
        math = [a for m, a in seen if m == "math"]
        if agreed(math):
            reason = "math_agrees"
        elif agreed([a for _, a in seen]):
            reason = "all_agree"
        elif len(seen) == 16:
            reason = "all_in"
        elif len(math) >= 4:
            reason = "enough_math"
        else:
            continue
        break
    winner = brute_winner([a for _, t, a in rows if t <= tick * poll])
    return tick, reason, 210 if winner is None else winner % 1000


def random_answers(seed, questions=60, hot=400):
    rng = random.Random(seed)
    rows = []
    for q in range(questions):
        many = hot if q == 0 else rng.randint(1, 20)
        spread = rng.choice([1, 2, 4, 40])
        for _ in range(many):
            answer = rng.choice(["", "x", "1.0"]) if rng.random() < 0.2 else str(rng.randint(-1, spread))
            rows.append((q, len(rows), rng.choice(["math", "code"]), rng.randint(0, 150), answer))
    return rows


@pytest.mark.parametrize("seed,deadline", [(1, 100), (2, 35), (3, 0)])
def test_stop_and_majority_match_a_plain_loop(spark, seed, deadline):
    rows = random_answers(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    groups = {}
    for q, _, m, t, a in rows:
        groups.setdefault(q, []).append((m, t, a))
    # Every second question has half the time, and one is not answered at all.
    closing = {q: deadline / (1 + q % 2) for q in [*groups, 999]}
    want = {q: brute_stop(groups.get(q, []), d) for q, d in closing.items()}
    questions = spark.createDataFrame([*closing.items()], "question_id bigint, deadline double")
    got = {r.question_id: (r.tick, r.reason, r.answer) for r in votes.early_stop_tick(questions, df).collect()}
    assert got == want
    assert got[999][1:] == ("deadline", 210)
    # Neither row order nor partitioning matters.
    mixed = {r.question_id: r.answer for r in votes.majority_answer(df.orderBy(F.rand(7)).repartition(7)).collect()}
    winners = {q: brute_winner([a for *_, a in r]) for q, r in groups.items()}
    assert mixed == {q: None if w is None else w % 1000 for q, w in winners.items()}


def test_positions_in_a_large_group(spark):
    rows = random_answers(5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = grouped_positions(df, ["question_id", "method"], ["arrival"], "generation_id")
    place = {r.generation_id: r.position for r in got.collect()}
    groups = {}
    for q, g, m, t, _ in rows:
        groups.setdefault((q, m), []).append((t, g))
    want = {g: i for r in groups.values() for i, (_, g) in enumerate(sorted(r), 1)}
    assert place == want


def test_positions_of_missing_values_and_of_continuous_times(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1]), i, rng.choice(["math", None]), rng.choice([None, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "question_id bigint, generation_id bigint, method string, arrival double").repartition(3)
    got = grouped_positions(df, ["question_id", "method"], ["arrival"], "generation_id").collect()
    groups = {}
    for q, g, m, t in rows:
        groups.setdefault((q, m), []).append((t is not None, t or 0, g))
    assert {r.generation_id: r.position for r in got} == {x[2]: i for r in groups.values() for i, x in enumerate(sorted(r), 1)}


def test_one_group_of_all_rows_is_spread(spark):
    df = spark.range(40_000).select(F.lit(1).alias("q"), F.col("id").alias("generation_id"), F.rand(2).alias("arrival"))
    found = grouped_positions(df, ["q"], ["arrival"], "generation_id")
    assert found.agg(F.max("position"), F.countDistinct("position")).first() == (40_000, 40_000)
    # Adaptive execution merges partitions as small as these; without it each holds its share.
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        parts = df.repartitionByRange("q", "arrival", "generation_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(key)
    assert len(parts) == 4 and max(r["count"] for r in parts) < 15_000


def test_answers_beyond_64_bits_vote(spark):
    big, huge = "100000000000000000000", str(2**99)
    cases = [[big, big, "5"], [huge, "-" + huge], ["+" + big, "0" + big[:1] + "_" + big[1:], huge + "1"], [str(2**99 + 1)], ["9", "10"], ["-9", "-10"]]
    got = {r.question_id: (r.weight, r.value) for r in votes.top_vote(answers_of(spark, cases)).collect()}
    assert got == {0: (4, big), 1: (2, huge), 2: (4, big), 3: (None, None), 4: (2, "10"), 5: (2, "-9")}
    modulo = {r.question_id: r.answer for r in votes.majority_answer(answers_of(spark, [[huge], ["-" + huge]])).collect()}
    assert modulo == {0: 2**99 % 1000, 1: -(2**99) % 1000}


def test_answers_of_any_length_vote(spark):
    """Whole numbers that a double holds are valid, whatever their length; others are not."""
    chance = random.Random(5)
    texts = [str(s * m * 2**e) for e in (0, 1, 19, 20, 21, 60, 147, 700, 970) for m in (1, 3, 2**53 - 1, 2**53, 2**53 + 1, 10**20 + 1) for s in (1, -1)]
    texts += [str(10**n + d) for n in (15, 16, 17, 22, 23, 40, 308) for d in (0, 1, -1, 2**30)] + [str(2**1024), str(2**1024 - 2**970), str(2**1024 - 2**969), "1" + "0" * 400, "0" * 400 + "7", "9" * 309]
    texts += [str(chance.getrandbits(53) << chance.randrange(0, 300)) for _ in range(100)] + [str(chance.getrandbits(200)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    got = {r.i: (r.v, r.m) for r in df.select("i", answer_value("t").alias("v"), floor_mod(answer_value("t")).alias("m")).collect()}
    assert got == {i: (str(number(t)), number(t) % 1000) if number(t) is not None else (None, None) for i, t in enumerate(texts)}
    cases = [[str(2**200), str(2**200 + 1), "9"], ["-" + str(2**200), "5"]]
    assert {r.question_id: r.answer for r in votes.majority_answer(answers_of(spark, cases)).collect()} == {0: 2**200 % 1000, 1: 5}


def test_a_missing_question_is_a_question(spark):
    rows = [(None, i, "math", 5 * i, "9") for i in range(3)] + [(1, 10, "code", 50, "4")]
    df, questions = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(None, 100.0), (1, 100.0), (2, 100.0)], "question_id bigint, deadline double")
    assert {r.question_id: r.answer for r in votes.predict_table(questions, df).collect()} == {None: 9, 1: 4, 2: 210}
    stops = {r.question_id: (r.tick, r.reason, r.answer) for r in votes.early_stop_tick(questions, df).collect()}
    assert stops == {None: (1, "math_agrees", 9), 1: (6, "deadline", 4), 2: (6, "deadline", 210)}
    closes = spark.createDataFrame([(None, 7), (1, 60)], "question_id bigint, closed_at bigint")
    late = {r.generation_id: r.late for r in votes.late_results(df, closes).collect()}
    assert late == {0: False, 1: False, 2: True, 10: False}


def test_full_agreement_stops_batch_runs(spark):
    rows = [(1, i, "code", i, "4") for i in range(20)] + [(2, 100 + i, "math", 1, "4") for i in range(3)]
    questions = spark.createDataFrame([(1, 100.0), (2, 100.0)], "question_id bigint, deadline double")
    got = votes.early_stop_tick(questions, spark.createDataFrame(rows, SCHEMA), full_agreement=16, full_count=-1)
    assert {r.question_id: (r.tick, r.reason) for r in got.collect()} == {1: (1, "all_agree"), 2: (6, "deadline")}


def test_poll_snapshots_end_with_the_deadline(spark):
    df = spark.createDataFrame([(1, 1, "math", 5, "3"), (1, 2, "math", 45, "3"), (1, 3, "code", 90, "4")], SCHEMA)
    got = sorted((r.tick, r.method, r.arrived) for r in votes.poll_snapshots(df, 50).collect())
    assert got == [(1, "math", 1), (2, "math", 1), (3, "math", 2)]


def test_intervals_do_not_grow_with_the_deadline(spark):
    df = spark.createDataFrame([(1, 1, "math", 5, "3"), (1, 2, "math", 45, "3"), (1, 3, "code", 90, "4"), (None, 4, "code", 15, "4")], SCHEMA)
    short, long = (votes.poll_intervals(df, deadline) for deadline in (100, 10**9))
    assert short.count() == long.count() == 4
    asked = spark.createDataFrame([(1, 2), (1, 10**7), (None, 3), (2, 1)], "question_id bigint, tick bigint")
    got = sorted(((r.question_id, r.tick, r.answer, r.arrived) for r in votes.arrived_at(long, asked).collect()), key=repr)
    assert got == sorted([(1, 2, "3", 1), (1, 10**7, "3", 2), (1, 10**7, "4", 1), (None, 3, "4", 1)], key=repr)


def test_late_results(spark):
    df = spark.createDataFrame([(1, 1, "math", 50, "3"), (1, 2, "code", 50, "3"), (1, 3, "code", 40, "4"), (2, 4, "code", 9, "1")], SCHEMA)
    closes = spark.createDataFrame([(1, 40)], "question_id bigint, closed_at bigint")
    got = {r.generation_id: (r.late, r.reason) for r in votes.late_results(df, closes).collect()}
    assert got == {1: (True, "final"), 2: (True, "terminated"), 3: (False, "final"), 4: (False, "final")}


def test_one_more_agreeing_vote_never_delays_the_stop(spark):
    rows, more = [], []
    for q, times in enumerate([[5, 70], [30, 31, 90], [10], [100, 120, 140], [1, 2, 3]]):
        rows += [(q, q * 100 + i, "code", t, "4") for i, t in enumerate(times)]
        more += [(q, q * 100 + 50, "code", 35, "4")]
    questions = spark.range(5).select(F.col("id").alias("question_id"), F.lit(150).alias("deadline"))
    stops = lambda r: {x.question_id: x.tick for x in votes.early_stop_tick(questions, spark.createDataFrame(r, SCHEMA)).collect()}
    before, after = stops(rows), stops(rows + more)
    assert all(after[q] <= before[q] for q in before)
