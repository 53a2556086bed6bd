"""Votes over answers: majority, frequencies, early stop, arrival.

Input rows: question_id, generation_id, method ('math' or 'code'), arrival (seconds since
the question started), answer (text). Every operator first reduces to counts per question
and value, so that a question with very many answers never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions.answers import DEFAULT_ANSWER, MODULUS, answer_value, floor_mod, numeric_order
from tallywork.operators.joins import join_on
from tallywork.operators.ranking import grouped_positions

# Fixed values of the stop rules.
POLL_SECONDS = 20
FULL_COUNT = 16
ENOUGH_MATH = 4
LEVELS = (1, 2, 3, 4, 5)


def vote_weight(value: Column, count: Column) -> Column:
    """Twice the count, but once for zero: zero counts half. NULL for an invalid answer."""
    return F.when(value.isNull(), None).when(value == "0", count).otherwise(count * 2)


def vote_frequency(value: Column, count: Column) -> Column:
    """The count, for zero half of it rounded up; 0 for an invalid answer."""
    return (
        F.when(value.isNull(), F.lit(0).cast("bigint"))
        .when(value == "0", F.floor((count + 1) / 2))
        .otherwise(count)
    )


def vote_counts(answers: DataFrame, *more: str) -> DataFrame:
    """Answers per question and value (NULL for invalid ones). Equal texts are counted before they are parsed."""
    texts = answers.groupBy("question_id", *more, "answer").agg(F.count("*").alias("votes"))
    valued = texts.select("question_id", *more, answer_value("answer").alias("value"), "votes")
    return valued.groupBy("question_id", *more, "value").agg(F.sum("votes").alias("votes"))


def top_vote(answers: DataFrame) -> DataFrame:
    """Value with the largest (weight, value) per question; NULL if no answer is valid."""
    value, votes = F.col("value"), F.col("votes")
    ballot = F.struct(vote_weight(value, votes).alias("weight"), numeric_order(value).alias("order"), value.alias("value"))
    return (
        vote_counts(answers)
        .groupBy("question_id")
        .agg(F.max(F.when(value.isNotNull(), ballot)).alias("top"))
        .select("question_id", F.col("top.weight").alias("weight"), F.col("top.value").alias("value"))
    )


def majority_answer(answers: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """Winner per question modulo 1,000. A tie goes to the larger value; NULL if no vote."""
    return top_vote(answers).select("question_id", floor_mod("value", modulus).alias("answer"))


def top_frequencies(answers: DataFrame, k: int = 3) -> DataFrame:
    """The k highest frequencies per question, one row each."""
    counted = vote_counts(answers).select(
        "question_id", "value", vote_frequency(F.col("value"), F.col("votes")).alias("frequency")
    )
    # The rank filter reaches below the shuffle: a task passes on at most k rows per question.
    order = Window.partitionBy("question_id").orderBy(F.desc("frequency"), numeric_order("value").desc_nulls_last())
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def vote_frequencies(answers: DataFrame) -> DataFrame:
    """Highest, second and third frequency per question, 0 where there are fewer."""
    names = ("highest", "second", "third")
    return top_frequencies(answers).groupBy("question_id").agg(
        *[
            F.coalesce(F.max(F.when(F.col("place") == i, F.col("frequency"))), F.lit(0).cast("bigint")).alias(n)
            for i, n in enumerate(names, 1)
        ]
    )


def agreement(highest: Column, second: Column, third: Column, full_agreement: int | None = None) -> Column:
    """The stop rule, on columns or on plain numbers; ``full_agreement`` replaces it by one
    threshold (batch runs)."""
    if full_agreement is not None:
        return highest >= full_agreement
    return (
        ((highest >= 2) & (second <= 0) & (third <= 0))
        | ((highest >= 3) & (second <= 1))
        | ((highest >= 4) & (second <= 3))
        | (highest >= 5)
    )


def early_answer(answers: DataFrame, full_agreement: int | None = None) -> DataFrame:
    rule = agreement(F.col("highest"), F.col("second"), F.col("third"), full_agreement)
    return vote_frequencies(answers).select("question_id", rule.alias("stop"))


def poll_tick(arrival: Column, poll: int = POLL_SECONDS) -> Column:
    """Number of the first poll that sees an arrival; polls come after 1, 2, ... periods."""
    return F.greatest(F.ceil(arrival / poll), F.lit(1)).cast("bigint")


def last_tick(deadline: float, poll: int = POLL_SECONDS) -> int:
    """The deadline is tested before each wait, so the last poll may pass it."""
    return int(deadline // poll) + 1 if deadline >= 0 else 0


def poll_intervals(answers: DataFrame, deadline: float, poll: int = POLL_SECONDS) -> DataFrame:
    """Counts of arrived answers per method and answer text with the polls they hold for, ``since`` to ``until``.

    A group of equal answers has a row for each poll that saw more of it, so rows grow with the
    answers, not with the deadline.
    """
    last = last_tick(deadline, poll)
    keys = ["question_id", "method", "answer"]
    counts = (
        answers.select(*keys, poll_tick(F.col("arrival"), poll).alias("since"))
        .where(F.col("since") <= last)
        .groupBy(*keys, "since")
        .agg(F.count("*").alias("n"))
    )
    in_time = Window.partitionBy(*keys).orderBy("since")
    return counts.select(
        *keys, F.sum("n").over(in_time).alias("arrived"), "since",
        F.coalesce(F.lead("since").over(in_time) - 1, F.lit(last).cast("bigint")).alias("until"),
    )


def arrived_at(intervals: DataFrame, asked: DataFrame) -> DataFrame:
    """Per row of ``asked`` (question_id, tick), the counts of ``poll_intervals`` that hold then."""
    met = join_on(intervals, asked.select("question_id", "tick"), ["question_id"])
    return met.where("tick BETWEEN since AND until").select("question_id", "method", "answer", "arrived", "tick")


def poll_snapshots(answers: DataFrame, deadline: float, poll: int = POLL_SECONDS) -> DataFrame:
    """At each poll the answers that have arrived, counted per method and answer text: the intervals written out."""
    return poll_intervals(answers, deadline, poll).select("question_id", "method", "answer", "arrived", F.explode(F.sequence("since", "until")).alias("tick"))


def last_poll(deadline: Column, poll: int = POLL_SECONDS) -> Column:
    """``last_tick`` of a column of deadlines."""
    return F.when(deadline >= 0, F.floor(deadline / poll) + 1).otherwise(0).cast("bigint")


def early_stop_tick(
    questions: DataFrame,
    answers: DataFrame,
    poll: int = POLL_SECONDS,
    full_count: int = FULL_COUNT,
    enough_math: int = ENOUGH_MATH,
    full_agreement: int | None = None,
) -> DataFrame:
    """First poll at which a question stops, the reason, and its answer then.

    ``questions`` has question_id and its deadline, in seconds since it started. A question
    without any answer stops at its deadline with the default. ``full_agreement`` replaces
    the stop rule by one threshold (batch runs).

    The rules only ask how many values have a frequency of at least 1 .. 5. A frequency
    never falls, so a value enters each of these five sets once: entries are counted per
    poll and summed over the polls, and so is the running winner. No poll looks at the
    answers again, and windows see at most one row per poll up to the last one.
    """
    levels = LEVELS if full_agreement is None else (full_agreement,)
    math, value = F.col("method") == "math", F.col("value")
    rows = answers.select(
        "question_id", math.cast("bigint").alias("math"), answer_value("answer").alias("value"),
        poll_tick(F.col("arrival"), poll).alias("tick"),
    )
    asked = questions.select("question_id", last_poll(F.col("deadline"), poll).alias("last"))
    counted = rows.groupBy("question_id", "value", "tick").agg(F.count("*").alias("n"), F.sum("math").alias("n_math"))
    # Counts meet their question, not answers; what comes after the last poll ends here.
    per_value = join_on(counted, asked, ["question_id"]).where(F.col("tick") <= F.col("last")).drop("last")
    over_polls = Window.partitionBy("question_id", "value").orderBy("tick")
    running = per_value.withColumn("all_now", F.sum("n").over(over_polls)).withColumn(
        "math_now", F.sum("n_math").over(over_polls)
    )

    def entries(scope: str, added: str) -> list[Column]:
        now = vote_frequency(value, F.col(scope))
        before = vote_frequency(value, F.col(scope) - F.col(added))
        return [F.sum(((before < k) & (now >= k)).cast("bigint")).alias(f"{added}_{k}") for k in levels]

    ballot = F.struct(vote_weight(value, F.col("all_now")).alias("weight"), numeric_order(value).alias("order"), value.alias("value"))
    per_poll = running.groupBy("question_id", "tick").agg(
        F.sum("n").alias("n"), F.sum("n_math").alias("n_math"),
        *entries("all_now", "n"), *entries("math_now", "n_math"),
        F.max(F.when(value.isNotNull(), ballot)).alias("top"),
    )
    so_far = Window.partitionBy("question_id").orderBy("tick")
    sums = ["n", "n_math", *[f"{s}_{k}" for s in ("n", "n_math") for k in levels]]
    state = per_poll.select(
        "question_id", "tick", *[F.sum(c).over(so_far).alias(c) for c in sums], F.max("top").over(so_far).alias("top")
    )

    def agreed(scope: str) -> Column:
        if full_agreement is not None:
            return F.col(f"{scope}_{full_agreement}") >= 1
        have = [None, *[F.col(f"{scope}_{k}") for k in LEVELS]]
        return (
            ((have[2] >= 1) & (have[1] <= 1))
            | ((have[3] >= 1) & (have[2] <= 1))
            | ((have[4] >= 1) & (have[4] <= 1))
            | (have[5] >= 1)
        )

    reason = (
        F.when(agreed("n_math"), "math_agrees")
        .when(agreed("n"), "all_agree")
        .when(F.col("n") == full_count, "all_in")
        .when(F.col("n_math") >= enough_math, "enough_math")
    )
    found = F.struct("tick", F.col("reason"), F.col("top.value").alias("value"))
    ends = state.withColumn("reason", reason).groupBy("question_id").agg(
        F.min(F.when(F.col("reason").isNotNull(), found)).alias("stop"), F.max_by("top.value", "tick").alias("last_value"),
    )
    stopped = F.col("stop").isNotNull()
    chosen = F.when(stopped, F.col("stop.value")).otherwise(F.col("last_value"))
    return join_on(asked, ends, ["question_id"], "left").select(
        "question_id",
        F.when(stopped, F.col("stop.tick")).otherwise(F.col("last")).alias("tick"),
        F.coalesce(F.col("stop.reason"), F.lit("deadline")).alias("reason"),
        F.coalesce(floor_mod(chosen), F.lit(DEFAULT_ANSWER).cast("bigint")).alias("answer"),
    )


def results_by_method(answers: DataFrame) -> DataFrame:
    """All answers with their place in arrival order per question and method."""
    rows = answers.select("question_id", "method", "arrival", "generation_id", "answer")
    return grouped_positions(rows, ["question_id", "method"], ["arrival"], "generation_id")


def union_methods(math_answers: DataFrame, code_answers: DataFrame) -> DataFrame:
    """Math answers and code answers in one table, duplicates kept."""
    return math_answers.unionByName(code_answers)


def predict_table(questions: DataFrame, answers: DataFrame, default: int = DEFAULT_ANSWER) -> DataFrame:
    """Question rows in, (question, answer) rows out; the default where no vote was valid."""
    voted = majority_answer(answers)
    return join_on(questions, voted, ["question_id"], "left").select(
        "question_id", F.coalesce("answer", F.lit(default).cast("bigint")).alias("answer")
    )


def late_results(answers: DataFrame, closes: DataFrame) -> DataFrame:
    """Mark output that came after its question had closed.

    ``closes`` has one row per question with ``closed_at``. A late code answer is
    'terminated' and still counts under its question; a late math answer stays 'final'.
    """
    late = F.coalesce(F.col("arrival") > F.col("closed_at"), F.lit(False))
    return join_on(answers, closes, ["question_id"], "left").select(
        "question_id", "generation_id", "method", "arrival", "answer", late.alias("late"),
        F.when(late & (F.col("method") == "code"), "terminated").otherwise("final").alias("reason"),
    )
