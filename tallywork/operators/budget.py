"""Time budget: a deadline per question, and the default answer past the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.answers import DEFAULT_ANSWER

# Fixed values, in seconds.
LOADING = 240
TOTAL = 17100
PER_QUESTION_IN_BATCH = 360


def budget_schedule(
    questions: DataFrame, start: float, count: Column | int, total: Column | float = TOTAL, loading: float = LOADING
) -> DataFrame:
    """Deadline of each question; ``idx`` counts them from 1, ``count`` is how many there are."""
    share = F.col("idx") * (F.lit(total) - F.lit(loading)) / F.lit(count)
    return questions.withColumn("deadline", (F.lit(start + loading) + share).cast("bigint"))


def batch_budget(count: Column | int) -> Column:
    """Total seconds of a batch run."""
    return F.lit(count) * PER_QUESTION_IN_BATCH


def deadline_default(questions: DataFrame, cutoff: Column | float, default: int = DEFAULT_ANSWER) -> DataFrame:
    """A question that starts after the final cutoff gets the default, others no answer yet."""
    late = F.col("started") > F.lit(cutoff)
    return questions.withColumn("answer", F.when(late, F.lit(default).cast("bigint")))
