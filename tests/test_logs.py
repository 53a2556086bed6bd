import random

import numpy as np
from pyspark.sql import functions as F

from tallywork.operators import budget, curate, logs, prompts, throttle

RUN = "question_id bigint, method string, generation_idx bigint, defer_count bigint"


def test_training_flag_follows_a_terminal_execution(spark):
    reasons = ["terminal_code_execution", "stop_token", "terminal_code_execution", "terminal_code_execution", "unassigned"]
    rows = [(1, "code", 2, 0, k, r) for k, r in enumerate(reasons, 1)] + [(1, "code", 2, 1, 2, "stop_token")]
    df = spark.createDataFrame(rows, RUN + ", request_counter bigint, reason string")
    got = {(r.defer_count, r.request_counter): r.training_flag for r in logs.training_flag(df).collect()}
    assert got == {(0, 1): False, (0, 2): True, (0, 3): False, (0, 4): True, (0, 5): True, (1, 2): False}


def test_eventual_answer_and_arrival(spark):
    rows = [
        (1, "math", 1, 0, "stream_complete", 10.0, None), (1, "math", 1, 0, "final", 30.0, "7"),
        (1, "code", 1, 1, "terminated", 12.5, ""), (2, "code", 2, 0, "final", 4.0, "x"),
    ]
    df = spark.createDataFrame(rows, RUN + ", reason string, log_time double, answer string")
    got = sorted((r.question_id, r.method, r.log_time, r.eventual_answer) for r in logs.fill_eventual_answer(df).collect())
    assert got == [(1, "code", 12.5, "-1"), (1, "math", 10.0, "7"), (1, "math", 30.0, "7"), (2, "code", 4.0, "x")]
    arrival = {(r.question_id, r.defer_count): r.arrival for r in logs.arrival_times(logs.closings(df)).collect()}
    assert arrival == {(1, 0): 30.0, (1, 1): 42.5, (2, 0): 4.0}


def test_last_duplicate_problem_wins(spark):
    problems = spark.createDataFrame([(1, 5, 10), (1, 9, 11), (2, 1, 12)], "question_id bigint, position bigint, answer bigint")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "question_id bigint")
    got = sorted((r.question_id, r.correct_answer) for r in logs.attach_correct_answer(rows, problems).collect())
    assert got == [(1, "11"), (2, "12"), (3, "")]


def test_normalize_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "question_id bigint, prompt string")
    b = spark.createDataFrame([(2, True, 9)], "question_id int, flag_for_training boolean, extra int")
    got = logs.normalize_logs(a, b)
    assert got.schema == logs.LOG_SCHEMA
    assert sorted((r.question_id, r.prompt, r.flag_for_training) for r in got.collect()) == [(1, "x", None), (2, None, True)]


def test_missing_times_sort_last(spark):
    rows = [(1, "code", 1, 0, None), (1, "code", 1, 0, 2.0), (0, "math", 1, 0, 9.0)]
    got = logs.sorted_logs(spark.createDataFrame(rows, RUN + ", log_time double")).collect()
    assert [r.log_time for r in got] == [9.0, 2.0, None]


def test_throttle_depends_on_the_last_kept(spark):
    rows = [(1, t) for t in (0.0, 3.0, 5.0, 6.0, 9.9, 10.0, 10.0, 30.0)] + [(2, 1.0)]
    df = spark.createDataFrame(rows, "generation_id bigint, t double")
    got = sorted(map(tuple, throttle.throttled_checks(df, "generation_id", "t").collect()))
    assert got == [(1, 0.0), (1, 5.0), (1, 10.0), (1, 30.0), (2, 1.0)]


def test_throttle_over_many_slices(spark):
    rng = random.Random(9)
    rows = [(k, round(rng.uniform(-40, 400), rng.choice([0, 1, 3]))) for k in range(12) for _ in range(rng.choice([1, 5, 60, 900]))]
    want = []
    for k in range(12):
        last = None
        for t in sorted({t for q, t in rows if q == k}):
            if last is None or t >= last + 5:
                want.append((k, t))
                last = t
    df = spark.createDataFrame(rows, "generation_id bigint, t double")
    for gaps in (1, 3, 1000):
        got = throttle.throttled_checks(df, "generation_id", "t", gaps_per_slice=gaps)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_running_prompt_and_counters(spark):
    rows = [(1, 1, 1, "b"), (1, 1, 0, "a"), (1, 2, 0, "c"), (2, 1, 0, "z")]
    df = spark.createDataFrame(rows, "generation_id bigint, request_counter bigint, chunk_idx bigint, chunk string")
    assert sorted(map(tuple, logs.running_prompt(df).collect())) == [(1, 1, "ab"), (1, 2, "abc"), (2, 1, "z")]
    assert sorted(map(tuple, logs.generation_counters(df).collect())) == [(1, 2, 2, 3), (2, 1, 1, 1)]


def test_budget_matches_evenly_spaced_deadlines(spark):
    start = 1_700_000_000
    want = [int(x) for x in np.linspace(start + 17100, start + 240, 51)][:50][::-1]
    questions = spark.range(1, 51).withColumnRenamed("id", "idx")
    got = [r.deadline for r in budget.budget_schedule(questions, start, 50).orderBy("idx").collect()]
    assert got == want
    batch = budget.budget_schedule(questions, start, 50, total=F.lit(50 * 360)).orderBy("idx").collect()
    assert [r.deadline for r in batch] == [int(x) for x in np.linspace(start + 18000, start + 240, 51)][:50][::-1]


def test_fill_keeps_braces(values):
    assert values([("Q{x}",)], "q string", prompts.fill("{q} in \\boxed{{}}", q="q")) == ["Q{x} in \\boxed{}"]


def test_handover(spark):
    rows = [
        (1, "code", 2, 0, "Q", "p```python\nx\n```", "", "7"), (1, "math", 2, 1, "Q", "", "", "8"),
        (2, "math", 1, 0, "R", "", "so", "7"), (3, "code", 2, 0, "S", "p", "b", ""), (4, "math", 1, 0, "T", "", "", ""),
    ]
    df = spark.createDataFrame(rows, RUN + ", question string, prompt string, buffer string, answer string")
    got = {r.question_id: (r.handover, r.to_method, r.to_answer) for r in prompts.handover_prompts(df).collect()}
    assert got[1] == (
        "Q" + prompts.SECTIONS_LEAD + "```python\nx\n```" + prompts.HINT_LEAD + "7" + prompts.MATH_CHECK, "math", "8",
    )
    assert got[2][0] == "R" + prompts.THOUGHTS_LEAD + "so" + prompts.THOUGHTS_END + prompts.HINT_LEAD + "7" + prompts.CODE_CHECK
    assert got[3] == ("S", None, None) and got[4][0] == "T"


def test_pairs(spark):
    rows = [(1, 5, "right"), (1, 2, "wrong"), (1, 3, "right"), (1, 9, "wrong"), (1, 11, "wrong"), (2, 1, "right"), (3, 4, None)]
    df = spark.createDataFrame(rows, "question_id bigint, position bigint, label string")
    assert [tuple(r) for r in curate.pair_right_wrong(df).collect()] == [(1, 1, 2, 3)]
    assert sorted(tuple(r) for r in curate.pair_right_wrong(df, all_pairs=True).collect()) == [(1, 1, 2, 3), (1, 2, 9, 5)]


def test_length_limits_are_strict(spark):
    df = spark.createDataFrame([(2999, 999), (3000, 1), (1, 1000)], "i int, o int")
    assert [r.i for r in curate.length_filter(df, input_tokens=F.col("i"), output_tokens=F.col("o")).collect()] == [2999]
    tokens = spark.createDataFrame([(16374,), (16375,)], "n int")
    assert [r.n for r in curate.context_limit_filter(tokens, F.col("n")).collect()] == [16374]


def test_keyword_selection(spark):
    df = spark.createDataFrame([("a", "Fred and"), ("b", "other")], "id string, problem string")
    got = {r.id: r.preset_answer for r in logs.select_questions(df, ["Triangle", "Fred"]).collect()}
    assert got == {"a": None, "b": 210}


def test_closing_records_are_never_flagged(spark):
    rows = [(1, "terminal_code_execution"), (2, "stop_token"), (2, "final"), (3, None)]
    df = spark.createDataFrame([(1, "code", 1, 0, n, r) for n, r in rows], "question_id int, method string, generation_idx int, defer_count int, request_counter int, reason string")
    got = {(r.request_counter, r.reason): r.training_flag for r in logs.training_flag(df).collect()}
    assert got == {(1, "terminal_code_execution"): False, (2, "stop_token"): True, (2, "final"): False, (3, None): False}


def test_training_set_from_raw_logs_in_order(spark):
    run = "question_id bigint, method string, generation_idx bigint, defer_count bigint"
    rows = []
    for q in range(12):
        for g, answer in enumerate([str(q), "77", "77", str(q), ""]):
            at = 1000 - q * 50 + g * 5
            rows += [
                (q, "code", g, 0, 1, "terminal_code_execution", f"p{q}-{g}-1", "b", None, at),
                (q, "code", g, 0, 2, "stop_token", f"p{q}-{g}-2", f"t{q}-{g}```python\nx", None, at + 1),
                (q, "code", g, 0, 2, "final", "end", "end", answer, at + 2),
            ]
    log = spark.createDataFrame(rows, f"{run}, request_counter bigint, reason string, prompt string, buffer string, answer string, position bigint").repartition(7)
    known = spark.createDataFrame([(q, 0, q) for q in range(10)], "question_id bigint, position bigint, answer bigint")
    got = [tuple(r) for r in curate.training_set(curate.answered(log, known)).collect()]
    want = [(1001 - q * 50 + g * 5, q, label, f"p{q}-{g}-2", f"t{q}-{g}", str(q)) for q in range(10) for g, label in ((0, "right"), (1, "wrong"))]
    assert got == sorted(want)


def test_sequential_order_is_that_of_the_positions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("position")).repartition(6)
    assert [r.position for r in curate.sequential_order(df).collect()] == list(range(500))


def test_throttle_through_many_levels(spark):
    rng = random.Random(2)
    times = {q: sorted({round(rng.uniform(0, 4000) if q else rng.choice([0, 900, 2500]) + rng.uniform(0, 9), 2) for _ in range(1500)}) for q in range(4)}
    rows = [(q if q < 3 else None, t) for q, ts in times.items() for t in ts] + [(1, None)]
    df = spark.createDataFrame(rows, "generation_id bigint, t double").repartition(5)
    want = []
    for q, ts in times.items():
        last = None
        for t in ts:
            if last is None or t >= last + 5:
                want.append((q if q < 3 else None, t))
                last = t
    for options in ({}, {"gaps_per_slice": 2, "neighbours": 3}, {"gaps_per_slice": 1, "neighbours": 2}):
        got = [tuple(r) for r in throttle.throttled_checks(df, "generation_id", "t", **options).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def kept_by(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t >= out[-1] + gap:
            out.append(t)
    return out


def test_throttle_by_links(spark):
    """Crowded keys keep the same times as others, whatever lies in one range or batch."""
    chance = random.Random(8)
    spread = {q: [round(chance.uniform(0, 300), 2) for _ in range(1500)] for q in (1, 2)} | {None: [float(t) for t in range(0, 900, 2)], 3: [7.0], 4: [1.0, 2.0, 3.0]}
    rows = [(q, t) for q, ts in spread.items() for t in ts] + [(1, None)]
    df = spark.createDataFrame(rows, "generation_id bigint, t double").repartition(5)
    want = sorted(((q, t) for q, ts in spread.items() for t in kept_by(ts, 5)), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for most in (0, 100, 600):
            got = throttle.throttled_checks(df, "generation_id", "t", gap=5, most_listed=most).collect()
            assert sorted(map(tuple, got), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_next_allowed_times(spark):
    chance = random.Random(3)
    times = {q: sorted({chance.randrange(0, 400) for _ in range(150)}) for q in ("a", "b", None)}
    df = spark.createDataFrame([(q, t) for q, ts in times.items() for t in ts], "k string, t bigint").repartition(4)
    got = {(r.k, r.t): r.to for r in throttle.next_allowed(df, "k", "t", 7).collect()}
    assert got == {(q, t): min((x for x in ts if x >= t + 7), default=None) for q, ts in times.items() for t in ts}


def test_runs_with_missing_keys_and_several_ends(spark):
    """One row in, one row out, whatever is missing in a run's key; the latest end counts."""
    rows = [
        (None, "code", 1, 0, 1, "terminal_code_execution", 5.0, None), (None, "code", 1, 0, 2, "stop_token", 8.0, None), (None, "code", 1, 0, 2, "terminated", 9.0, "3"),
        (None, "code", 1, 0, 2, "final", 12.0, "4"), (None, "math", 1, 1, 1, "final", 2.0, "5"), (1, "code", None, 0, 1, "final", 6.0, ""), (1, None, 2, 0, 1, "final", 7.0, "8"),
        (2, "code", 1, 0, 1, "terminal_code_execution", 1.0, None), (2, "code", 1, 0, 1, "terminal_code_execution", 1.0, None), (2, "code", 1, 0, 2, "stop_token", 2.0, None),
    ]
    df = spark.createDataFrame(rows, RUN + ", request_counter bigint, reason string, log_time double, answer string")
    filled = logs.fill_eventual_answer(df).select("question_id", "method", "reason", "eventual_answer").collect()
    assert sorted(map(tuple, filled), key=repr) == sorted([(r[0], r[1], r[5], "5" if r[1] == "math" else "4" if r[0] is None else {None: "-1", 2: "8", 1: None}[r[2]]) for r in rows], key=repr)
    flags = logs.training_flag(df).select("question_id", "request_counter", "reason", "training_flag").collect()
    assert len(flags) == len(rows) and {(r[0], r[2]) for r in flags if r[3]} == {(None, "stop_token"), (2, "stop_token")}
    arrivals = logs.arrival_times(logs.closings(df)).collect()
    assert sorted((r.question_id is None, r.arrival) for r in arrivals) == [(False, 6.0), (False, 7.0), (True, 9.0), (True, 12.0), (True, 14.0)]
    known = spark.createDataFrame([(1, 0, 8)], "question_id bigint, position bigint, answer bigint")
    outcome = {(r.method, r.outcome): r.runs for r in logs.generation_outcome(logs.closings(df), known).collect()}
    assert outcome == {("code", "unknown"): 1, ("math", "unknown"): 1, ("code", "none"): 1, (None, "right"): 1}


def test_folded_prompts_do_not_grow_with_the_requests(spark):
    """The same text in one request and in sixty-four takes about as much room; chosen prompts are cut from it."""
    def chunks(requests):
        return [(1, r, i, "abcdefgh" * 8) for r in range(requests) for i in range(256 // requests)]

    schema = "generation_id bigint, request_counter bigint, chunk_idx bigint, chunk string"
    sizes = []
    for requests in (1, 64):
        folded = logs.folded_prompts(spark.createDataFrame(chunks(requests), schema))
        row = folded.first()
        sizes.append(len(row.text) + 16 * len(row.ends))
        whole = "".join(c for *_, c in chunks(requests))
        got = [tuple(r) for r in logs.prompts_at(folded, F.col("request_counter") % 7 == 3).collect()]
        assert sorted(got) == [(1, r, whole[: (r + 1) * 256 // requests * 64]) for r in range(requests) if r % 7 == 3]
    assert sizes[1] < 1.1 * sizes[0]


def test_samples_of_any_size(spark):
    ids = [f"p{i}" for i in range(500)] + ["twice", "twice", None]
    df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, n bigint").repartition(4)
    key = F.md5(F.concat(F.col("id"), F.lit("-43")).cast("binary"))
    for limit in (0, 1, 7, 250, 503, 900):
        want = sorted((r.id for r in df.orderBy(key, "id").limit(limit).collect()), key=repr)
        for few in (10_000, 1):
            assert sorted((r.id for r in logs.sample_problems(df, limit, few=few).collect()), key=repr) == want
