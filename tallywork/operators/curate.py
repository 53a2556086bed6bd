"""Training-set curation from generation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.text import tokens_below, training_span
from tallywork.operators.logs import attach_correct_answer, fill_eventual_answer, training_flag
from tallywork.operators.ranking import grouped_positions

# Fixed values, in tokens.
CONTEXT_LIMIT = 16384
CONTEXT_MARGIN = 10
MAX_INPUT = 3000
MAX_OUTPUT = 1000


def context_limit_filter(prompts: DataFrame, tokens: Column | None = None, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Prompts that leave room to generate; pass a token column if the table has one."""
    room = limit - CONTEXT_MARGIN
    return prompts.where(tokens_below("prompt", room + 1) if tokens is None else tokens <= room)


def length_filter(
    rows: DataFrame, prompt: Column | str = "prompt", completion: Column | str = "completion",
    input_tokens: Column | None = None, output_tokens: Column | None = None,
    max_input: int = MAX_INPUT, max_output: int = MAX_OUTPUT,
) -> DataFrame:
    """Training rows of fewer tokens than the limits; pass token columns if the table has them."""
    short_input = tokens_below(prompt, max_input) if input_tokens is None else input_tokens < max_input
    short_output = tokens_below(completion, max_output) if output_tokens is None else output_tokens < max_output
    return rows.where(short_output & short_input)


def right_or_wrong(eventual: Column, correct: Column) -> Column:
    """'right', 'wrong', or NULL when a run gave no answer or none is known."""
    return F.when((eventual == "-1") | (eventual == "") | (correct == ""), None).when(eventual == correct, "right").otherwise("wrong")


def pair_right_wrong(labelled: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Per question the first wrong and the first right row; optionally second with second, and so on.

    ``labelled`` has question_id, position (a unique whole number) and label. The result has
    question_id, pair, wrong_position, right_position.
    """
    rows = labelled.where("label IS NOT NULL").select("question_id", "position", "label")
    if all_pairs:
        rows = grouped_positions(rows, ["question_id", "label"], [], "position", name="pair")
    else:
        rows = rows.withColumn("pair", F.lit(1).cast("bigint"))
    return (
        rows.groupBy("question_id", "pair")
        .agg(
            F.min(F.when(F.col("label") == "wrong", F.col("position"))).alias("wrong_position"),
            F.min(F.when(F.col("label") == "right", F.col("position"))).alias("right_position"),
        )
        .where("wrong_position IS NOT NULL AND right_position IS NOT NULL")
    )


def sequential_order(rows: DataFrame, ordinal: str = "position") -> DataFrame:
    """Training rows in file order, by their explicit ordinal."""
    return rows.orderBy(ordinal)


def eligible_rows(logs: DataFrame) -> DataFrame:
    """Flagged records within the token limits, with their label and without their texts."""
    kept = length_filter(logs.where("flag_for_training"), "prompt", training_span("buffer"))
    label = right_or_wrong(F.col("eventual_answer"), F.col("correct_answer"))
    return kept.select("question_id", "position", label.alias("label"))


def answered(logs: DataFrame, problems: DataFrame) -> DataFrame:
    """Raw log records with the training flag, the answer of their run, and the known one."""
    flagged = training_flag(logs.drop("flag_for_training", "eventual_answer", "correct_answer"))
    filled = fill_eventual_answer(flagged.withColumnRenamed("training_flag", "flag_for_training"))
    return attach_correct_answer(filled, problems)


def training_set(logs: DataFrame, max_input: int = MAX_INPUT, max_output: int = MAX_OUTPUT) -> DataFrame:
    """Paired training rows in order: position, question, label, prompt, completion, answer.

    ``logs`` are the records of ``answered``, with a position. One aggregate per question and
    label carries the texts of the first row along, so nothing is joined, and a task passes on
    one row per question and label.
    """
    label = right_or_wrong(F.col("eventual_answer"), F.col("correct_answer"))
    completion = training_span("buffer")
    rows = length_filter(logs.where("flag_for_training"), "prompt", completion, max_input=max_input, max_output=max_output)
    text = F.struct("prompt", completion.alias("completion"), "correct_answer")
    labelled = rows.select("question_id", label.alias("label"), "position", text.alias("text")).where("label IS NOT NULL")
    first = labelled.groupBy("question_id", "label").agg(F.min("position").alias("position"), F.min_by("text", "position").alias("text"))
    both = first.groupBy("question_id").agg(F.collect_list(F.struct("label", "position", "text")).alias("pair"))
    paired = both.where(F.size("pair") == 2).select("question_id", F.explode("pair").alias("row"))
    return sequential_order(paired.select("row.position", "question_id", "row.label", "row.text.*"))
