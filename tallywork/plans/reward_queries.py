"""Rewards, weights and advantages over whole completions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallywork.functions import rewards as rw
from tallywork.operators import scoring
from tallywork.operators.stages import written
from tallywork.plans.inputs import read_input, with_inputs
from tallywork.plans.registry import query
from tallywork.plans.text_queries import STRIP, TOKENS

PER_CALL = 16


def _preference(length: str, preferred: float, scaling: float) -> str:
    x = f"(CAST({length} AS DOUBLE) / {preferred})"
    return f"pow(least(exp(1) * {x} * exp(-{x}), 1.0), {scaling})"


VALID = "(contains(completion, '</think>') AND contains(completion, 'oxed{') <> contains(completion, '```python'))"
# One row per completion with every reward; T calls in all, counter k per call.
SCORES = f"""
base AS (
  SELECT *, CASE WHEN {VALID} THEN 0 ELSE -1 END AS penalty,
         regexp_extract(completion, '\\\\boxed\\{{(.*?)\\}}', 1) AS boxed,
         string_split(completion, '</think>')[1] AS head, contains(completion, '</think>') AS thought
  FROM fx_completions),
measured AS (
  SELECT *, {TOKENS.format(c='completion')} AS tokens,
         CASE WHEN thought THEN {TOKENS.format(c='head')} ELSE 0 END AS thinking,
         string_split(CASE WHEN thought THEN {STRIP.format(c='head')} ELSE completion END, chr(10) || chr(10)) AS parts
  FROM base),
rewards AS (
  SELECT question_id, generation_id, call_idx,
         0.5 * {_preference('thinking', 246, 0.95)} + 0.5 * {_preference('tokens', 256, 0.95)} + penalty AS length_reward,
         (1 + list_sum(list_transform(parts, lambda p: {_preference('length(p)', 100, 0.9)} * (length(p) + 100))))
           / (1 + list_sum(list_transform(parts, lambda p: length(p) + 100))) + penalty AS format_reward,
         CASE WHEN boxed = '' AND NOT contains(completion, '```python') THEN -0.5 WHEN boxed = '' THEN 0
              WHEN boxed IS DISTINCT FROM CAST(correct_answer AS VARCHAR) THEN -1 ELSE 1 END + penalty AS correctness_reward
  FROM measured),
calls AS (SELECT count(*) // {PER_CALL} AS total FROM fx_completions),
weights AS (
  SELECT call_idx, 0.75e0 * greatest(0, least(1, (call_idx - total // 4) / (total - total // 4))) AS correctness_weight,
         (1 - 0.75e0 * greatest(0, least(1, (call_idx - 1 - total // 4) / (total - total // 4)))) / 2 AS style_weight
  FROM (SELECT DISTINCT call_idx FROM fx_completions), calls),
scored AS (
  SELECT question_id, generation_id, r.call_idx, style_weight * (format_reward + length_reward) AS style,
         correctness_weight * correctness_reward AS correctness, 0.001e0 * format_reward AS format_logged,
         0.001e0 * length_reward AS length_logged, 0.001e0 * correctness_reward AS correctness_logged
  FROM rewards r JOIN weights w ON w.call_idx = r.call_idx),
totals AS (SELECT *, style + correctness + format_logged + length_logged + correctness_logged AS total_reward FROM scored)
"""


def _sql(body: str) -> str:
    return with_inputs(f"WITH {SCORES} {body}", "completions")


def _round(df, *names, digits=6):
    """Doubles are compared at six digits; means of scores, which end in a five there, at nine."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _completions(spark, folder):
    return read_input(spark, folder, "completions")


def _total_calls(completions):
    """Calls of one pass over the completions."""
    return completions.agg(F.floor(F.count("*") / PER_CALL)).scalar()


def _scored(spark, folder):
    completions = _completions(spark, folder)
    return scoring.score(completions, _total_calls(completions))


@query("length_preference", with_inputs(f"""
SELECT generation_id, round({_preference('length(completion)', 256, 1)}, 6) + 0e0 AS score,
       round(least({_preference('length(completion)', 4000, 1)}, 0.8) * 1.25, 6) + 0e0 AS capped FROM fx_completions""", "completions"))
def length_preference(spark, folder):
    length = F.length("completion")
    return _completions(spark, folder).select(
        "generation_id", F.round(rw.length_preference(length), 6).alias("score"),
        F.round(rw.length_preference(length, 4000, 0.8), 6).alias("capped"),
    )


@query("format_valid", with_inputs(f"SELECT generation_id, {VALID} AS valid FROM fx_completions", "completions"))
def format_valid(spark, folder):
    return _completions(spark, folder).select("generation_id", rw.format_valid("completion").alias("valid"))


@query("length_reward", _sql("SELECT generation_id, round(length_reward, 6) + 0e0 AS reward FROM rewards"))
def length_reward(spark, folder):
    return _completions(spark, folder).select("generation_id", F.round(rw.length_reward("completion"), 6).alias("reward"))


@query("format_reward", _sql("SELECT generation_id, round(format_reward, 6) + 0e0 AS reward FROM rewards"))
def format_reward(spark, folder):
    return _completions(spark, folder).select("generation_id", F.round(rw.format_reward("completion"), 6).alias("reward"))


@query("correctness_reward", _sql("SELECT generation_id, CAST(correctness_reward AS DOUBLE) AS reward FROM rewards"))
def correctness_reward(spark, folder):
    return _completions(spark, folder).select(
        "generation_id", rw.correctness_reward("completion", "correct_answer").alias("reward")
    )


@query("style_reward", _sql("SELECT generation_id, round(style, 6) + 0e0 AS style FROM totals"))
def style_reward(spark, folder):
    return _round(_scored(spark, folder).select("generation_id", "style"), "style")


@query("weighted_correctness", _sql("SELECT generation_id, round(correctness, 6) + 0e0 AS correctness FROM totals"))
def weighted_correctness(spark, folder):
    return _round(_scored(spark, folder).select("generation_id", "correctness"), "correctness")


LOGGED = ("format_logged", "length_logged", "correctness_logged")


@query("reference_rewards", _sql(
    "SELECT generation_id, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in LOGGED) + " FROM totals"))
def reference_rewards(spark, folder):
    return _round(_scored(spark, folder).select("generation_id", *LOGGED), *LOGGED)


@query("total_reward", _sql("SELECT generation_id, round(total_reward, 6) + 0e0 AS total_reward FROM totals"))
def total_reward(spark, folder):
    return _round(_scored(spark, folder).select("generation_id", "total_reward"), "total_reward")


@query("reward_len", with_inputs(
    "SELECT generation_id, CAST(-abs(100 - length(completion)) AS DOUBLE) AS reward FROM fx_completions", "completions"))
def reward_len(spark, folder):
    return _completions(spark, folder).select("generation_id", rw.char_length_reward("completion").alias("reward"))


@query("reward_weight_schedule", _sql("""
SELECT call_idx, round(correctness_weight, 6) + 0e0 AS correctness_weight, round(style_weight, 6) + 0e0 AS style_weight FROM weights"""))
def reward_weight_schedule(spark, folder):
    completions = _completions(spark, folder)
    calls = completions.select("call_idx").distinct()
    weights = scoring.weight_schedule(calls, _total_calls(completions))
    return _round(weights, "correctness_weight", "style_weight")


@query("group_advantage", with_inputs("""
WITH r AS (SELECT question_id, generation_id, CAST(-abs(100 - length(completion)) AS DOUBLE) AS reward FROM fx_completions)
SELECT *, round(reward - avg(reward) OVER (PARTITION BY question_id), 6) + 0e0 AS advantage FROM r""", "completions"))
def group_advantage(spark, folder):
    # The texts are read once; the narrow rewards feed both the mean and the difference.
    rewards = written(_completions(spark, folder).select(
        "question_id", "generation_id", rw.char_length_reward("completion").alias("reward")
    ), "rewards")
    return _round(scoring.group_advantage(rewards, reward="reward"), "advantage")


MEANS = (*scoring.REWARDS, "total_reward")


EVALUATED = SCORES.replace("fx_completions", "fx_evaluation").replace(
    f"calls AS (SELECT count(*) // {PER_CALL} AS total FROM fx_evaluation)", f"calls AS (SELECT count(*) // {PER_CALL} AS total FROM fx_completions)")
AVERAGES = "call_idx, count(*) AS completions, call_idx % 16 = 0 AS evaluated, " + ", ".join(f"round(avg({c}), 9) + 0e0 AS mean_{c}" for c in MEANS)


@query("reward_step_metrics", with_inputs(f"""
SELECT 'training' AS data_set, * FROM (WITH {SCORES} SELECT {AVERAGES} FROM totals GROUP BY call_idx)
UNION ALL SELECT 'evaluation', * FROM (WITH {EVALUATED} SELECT {AVERAGES} FROM totals GROUP BY call_idx)""", "completions", "evaluation"))
def reward_step_metrics(spark, folder):
    completions, evaluation = _completions(spark, folder), read_input(spark, folder, "evaluation")
    total = _total_calls(completions)
    metrics = scoring.reward_step_metrics(scoring.score(completions, total), scoring.score(evaluation, total))
    return _round(metrics, *[f"mean_{c}" for c in MEANS], digits=9)


@query("scored_groups", _sql("""
SELECT call_idx, question_id, generation_id, round(total_reward, 6) + 0e0 AS total_reward,
       round(total_reward - avg(total_reward) OVER (PARTITION BY question_id), 6) + 0e0 AS advantage FROM totals"""))
def scored_groups(spark, folder):
    # Scoring reads the texts; its narrow result feeds both the mean and the difference.
    scored = written(_scored(spark, folder), "scored")
    advantages = scoring.group_advantage(scored)
    return _round(
        advantages.select("call_idx", "question_id", "generation_id", "total_reward", "advantage"),
        "total_reward", "advantage",
    )


@query("align_completions", with_inputs("""
SELECT c.question_id, c.generation_id, c.call_idx, c.completion, a.correct_answer
FROM fx_completions c JOIN fx_completions a ON a.question_id IS NOT DISTINCT FROM c.question_id AND a.generation_id = c.generation_id
""", "completions"))
def align_completions(spark, folder):
    completions = _completions(spark, folder)
    answers = completions.select("question_id", "generation_id", "correct_answer")
    return scoring.align_completions(completions.drop("correct_answer"), answers)


@F.pandas_udf(DoubleType())
def _parity(generation: pd.Series) -> pd.Series:
    """The contract of a reward in Python, on a narrow column."""
    return (generation % 2).astype("float64")


def _exclamations(completion: Column) -> Column:
    return F.regexp_count(completion, F.lit("!")).cast("double")


def distinct_words(completions: list[str], question_id: list[int | None], **columns: list) -> list[float | None]:
    """A reward as users write it, over lists: the share of words that differ; none without a question."""
    shares = []
    for text, question in zip(completions, question_id):
        words = [w for w in text.split(" ") if w]
        shares.append(None if question is None or not words else len(set(words)) / len(words))
    return shares


@query("custom_rewards", _sql("""
SELECT r.generation_id, CAST(-abs(100 - length(completion)) AS DOUBLE) AS length_distance,
       CAST(correctness_reward AS DOUBLE) AS correct,
       0.1e0 * len(regexp_extract_all(completion, '!')) AS exclamations, 2e0 * (r.generation_id % 2) AS parity,
       round(words, 6) + 0e0 AS distinct_words,
       round(-abs(100 - length(completion)) + correctness_reward + 0.1e0 * len(regexp_extract_all(completion, '!'))
             + 2 * (r.generation_id % 2) + coalesce(words, 0), 6) + 0e0 AS total_reward
FROM rewards r JOIN (SELECT *, CASE WHEN question_id IS NOT NULL AND len(w) > 0 THEN 0.5e0 * len(list_distinct(w)) / len(w) END AS words
       FROM (SELECT *, list_filter(string_split(completion, ' '), lambda x : x <> '') AS w FROM fx_completions)) c ON c.generation_id = r.generation_id"""))
def custom_rewards(spark, folder):
    rewards = (
        scoring.RewardSet()
        .add("length_distance", rw.char_length_reward)
        .add("correct", rw.correctness_reward, "completion", "correct_answer")
        .add("exclamations", _exclamations, weight=0.1)
        .add("parity", _parity, "generation_id", weight=2.0)
        .add_function(distinct_words, weight=0.5)
    )
    return _round(rewards.apply(_completions(spark, folder), ["generation_id"]), "distinct_words", "total_reward")
