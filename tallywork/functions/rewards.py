"""Reward functions over (completion, correct answer) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork.functions.text import (
    END_OF_THOUGHT, PYTHON_FENCE, first_boxed, strip, thought_and_rest, token_count,
)

# --- Fixed values of the scoring rules ----------------------------------------------
PREFERRED_TOKENS = 256
PREFERRED_THINKING_TOKENS = 246
LENGTH_SCALING = 0.95
PREFERRED_PARAGRAPH = 100
PARAGRAPH_SCALING = 0.90
PARAGRAPH_BONUS = 100
MAX_CORRECTNESS_WEIGHT = 0.75
LOGGING_WEIGHT = 0.001
PREFERRED_CHARACTERS = 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def length_preference(length: Column, preferred: float = 256, ceiling: float = 1.0, scaling: float = 1.0) -> Column:
    """1 at the preferred length, falling to 0 on both sides."""
    x = length / F.lit(float(preferred))
    y = F.lit(math.e) * x * F.exp(-x)
    return F.pow(F.least(y, F.lit(float(ceiling))), F.lit(float(scaling))) / F.lit(float(ceiling))


def format_valid(completion: Column | str) -> Column:
    """Has the end-of-thought marker, and either a box or a python fence but not both."""
    c = _col(completion)
    boxed, code = F.contains(c, F.lit("oxed{")), F.contains(c, F.lit(PYTHON_FENCE))
    return F.contains(c, F.lit(END_OF_THOUGHT)) & (boxed != code)


def format_penalty(completion: Column | str) -> Column:
    """What each reward takes off a completion of another format."""
    return F.when(format_valid(completion), 0.0).otherwise(-1.0)


def token_lengths(completion: Column | str) -> tuple[Column, Column]:
    """Tokens of the thinking part (0 without its end marker) and of the whole completion."""
    head, rest = thought_and_rest(completion)
    tokens = token_count(head)
    thinking = F.when(F.contains(_col(completion), F.lit(END_OF_THOUGHT)), tokens).otherwise(F.lit(0).cast("bigint"))
    return thinking, tokens + token_count(rest)


def length_reward(
    completion: Column | str, thinking: Column | None = None, tokens: Column | None = None, penalty: Column | None = None
) -> Column:
    """Half thinking length, half full length; columns of tokens and of the penalty may be supplied."""
    if thinking is None or tokens is None:
        thinking, tokens = token_lengths(completion)
    return (
        0.5 * length_preference(thinking, PREFERRED_THINKING_TOKENS, scaling=LENGTH_SCALING)
        + 0.5 * length_preference(tokens, PREFERRED_TOKENS, scaling=LENGTH_SCALING)
        + (format_penalty(completion) if penalty is None else penalty)
    )


def format_reward(completion: Column | str, penalty: Column | None = None) -> Column:
    """Paragraphs of the thinking part should be near 100 characters."""
    c = _col(completion)
    thinking = F.when(
        F.contains(c, F.lit(END_OF_THOUGHT)), strip(F.substring_index(c, END_OF_THOUGHT, 1))
    ).otherwise(c)
    lengths = F.transform(F.split(thinking, "\n\n"), lambda p: F.length(p).cast("double"))

    def add(total: Column, length: Column) -> Column:
        score = length_preference(length, PREFERRED_PARAGRAPH, scaling=PARAGRAPH_SCALING)
        return F.struct(
            (total["scored"] + score * (length + PARAGRAPH_BONUS)).alias("scored"),
            (total["seen"] + length + PARAGRAPH_BONUS).alias("seen"),
        )

    start = F.struct(F.lit(1.0).alias("scored"), F.lit(1.0).alias("seen"))
    share = F.aggregate(lengths, start, add, lambda t: t["scored"] / t["seen"])
    return share + (format_penalty(c) if penalty is None else penalty)


def correctness_reward(completion: Column | str, correct_answer: Column | str, penalty: Column | None = None) -> Column:
    """-2 .. 1; the boxed text is compared as text, and no text equals an unknown answer."""
    c, boxed = _col(completion), first_boxed(completion)
    score = (
        F.when((boxed == "") & ~F.contains(c, F.lit(PYTHON_FENCE)), -0.5)
        .when(boxed == "", 0.0)
        .when(~boxed.eqNullSafe(_col(correct_answer).cast("string")), -1.0)
        .otherwise(1.0)
    )
    return score + (format_penalty(c) if penalty is None else penalty)


def char_length_reward(completion: Column | str) -> Column:
    """Minus the distance of the character count from 100."""
    return (-F.abs(F.lit(PREFERRED_CHARACTERS) - F.length(_col(completion)))).cast("double")


def correctness_weight(counter: Column, total_calls: Column | int) -> Column:
    """0 for the first quarter of the calls, then linear to 0.75 at the last."""
    total = F.lit(total_calls) if isinstance(total_calls, int) else total_calls
    quarter = F.floor(total / 4)
    span = total - quarter
    # No span to grow over: at or past the quarter counts as grown.
    factor = F.when(span == 0, F.when(counter >= quarter, 1.0).otherwise(0.0)).otherwise(
        F.try_divide((counter - quarter).cast("double"), span.cast("double"))
    )
    return MAX_CORRECTNESS_WEIGHT * F.greatest(F.lit(0.0), F.least(F.lit(1.0), factor))


def style_weight(counter: Column, total_calls: Column | int) -> Column:
    """Weight of each of the two style rewards."""
    return (1.0 - correctness_weight(counter, total_calls)) / 2.0
