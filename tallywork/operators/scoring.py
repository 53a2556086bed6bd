"""Rewards of completions, their weights over the training calls, and advantages.

Input rows: question_id, generation_id, call_idx (1, 2, ...), completion, correct_answer.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions import rewards as rw

EVALUATION_STEPS = 16
REWARDS = ("style", "correctness", "format_logged", "length_logged", "correctness_logged")


def align_completions(completions: DataFrame, answers: DataFrame) -> DataFrame:
    """Pair each completion with its answer by key, never by position; a missing question is a key too."""
    keyed = answers.select(
        F.col("question_id").alias("__question"), F.col("generation_id").alias("__generation"),
        *[c for c in answers.columns if c not in ("question_id", "generation_id")],
    )
    same = F.col("question_id").eqNullSafe(F.col("__question")) & F.col("generation_id").eqNullSafe(F.col("__generation"))
    return completions.join(keyed, same).drop("__question", "__generation")


def weight_schedule(calls: DataFrame, total_calls: Column | int) -> DataFrame:
    """Weights that call k uses: style is scored before correctness raises the counter."""
    return _with_weights(calls, total_calls).select("call_idx", "correctness_weight", "style_weight")


def _with_weights(rows: DataFrame, total_calls: Column | int) -> DataFrame:
    k, total = F.col("call_idx"), F.col("__total_calls")
    counted = rows.withColumn("__total_calls", F.lit(total_calls) if isinstance(total_calls, int) else total_calls)
    return counted.select(
        *rows.columns,
        rw.correctness_weight(k, total).alias("correctness_weight"),
        rw.style_weight(k - 1, total).alias("style_weight"),
    )


def score(
    completions: DataFrame, total_calls: Column | int, thinking: Column | None = None, tokens: Column | None = None
) -> DataFrame:
    """The five reward terms of each completion and their sum; the text is left behind.

    Pass the token counts of the thinking part and of the whole if the table has them.
    """
    if thinking is None or tokens is None:
        thinking, tokens = rw.token_lengths("completion")
    # Lengths and the format test are columns of their own, so that each text is measured once.
    measured = completions.select("*", thinking.alias("__thinking"), tokens.alias("__tokens"), rw.format_penalty("completion").alias("__penalty"))
    penalty = F.col("__penalty")
    base = measured.select(
        "question_id", "generation_id", "call_idx",
        rw.format_reward("completion", penalty).alias("format_reward"),
        rw.length_reward("completion", F.col("__thinking"), F.col("__tokens"), penalty).alias("length_reward"),
        rw.correctness_reward("completion", "correct_answer", penalty).alias("correctness_reward"),
    )
    style = F.col("style_weight") * (F.col("format_reward") + F.col("length_reward"))
    terms = _with_weights(base, total_calls).select(
        "question_id", "generation_id", "call_idx",
        style.alias("style"),
        (F.col("correctness_weight") * F.col("correctness_reward")).alias("correctness"),
        (rw.LOGGING_WEIGHT * F.col("format_reward")).alias("format_logged"),
        (rw.LOGGING_WEIGHT * F.col("length_reward")).alias("length_logged"),
        (rw.LOGGING_WEIGHT * F.col("correctness_reward")).alias("correctness_logged"),
    )
    return terms.withColumn("total_reward", sum((F.col(r) for r in REWARDS[1:]), F.col(REWARDS[0])))


def reward_step_metrics(scored: DataFrame, evaluation: DataFrame, evaluation_steps: int = EVALUATION_STEPS) -> DataFrame:
    """Mean of each reward per call of the training set, and per step of the evaluation set.

    The evaluation set is scored at the start (call 0) and after every ``evaluation_steps``
    calls; its completions carry the call they were made after.
    """

    def means(rows: DataFrame, name: str) -> DataFrame:
        measured = [F.avg(r).alias(f"mean_{r}") for r in (*REWARDS, "total_reward")]
        return rows.groupBy(F.lit(name).alias("data_set"), "call_idx").agg(F.count("*").alias("completions"), *measured)

    due = evaluation.where(F.col("call_idx") % evaluation_steps == 0)
    both = means(scored, "training").unionByName(means(due, "evaluation"))
    return both.withColumn("evaluated", F.col("call_idx") % evaluation_steps == 0)


def group_advantage(scored: DataFrame, group: str = "question_id", reward: str = "total_reward") -> DataFrame:
    """Reward minus the mean reward of its group, without dividing by a deviation.

    The mean is aggregated and joined back, so that rows of a very large group stay spread:
    a window would bring each group to one task. Rows without a group are one group. The
    scores are used twice, so a frame that is costly to compute should be a table.
    """
    means = scored.groupBy(F.col(group).alias("__group")).agg(F.avg(reward).alias("__mean"))
    return (
        scored.join(means, F.col(group).eqNullSafe(F.col("__group")))
        .withColumn("advantage", F.col(reward) - F.col("__mean"))
        .select(*scored.columns, "advantage")
    )


#: Names by which functions ask for the two lists that every reward gets, and their columns.
CALL_LISTS = {"prompts": "prompt", "completions": "completion"}
_KEPT, _PLACE = "__kept", "__place"


class PythonReward:
    """A function of lists to a list of numbers, bound to columns by the names of its arguments.

    ``prompts`` and ``completions`` are the columns prompt and completion, any other argument is
    the column of its name; ``**columns`` gets all columns that are left. An argument with a
    default may lack its column. None in the result is a missing reward.
    """

    def __init__(self, function: Callable[..., list[float | None]]):
        self.function = function
        self.named: dict[str, bool] = {}
        self.takes_rest = False
        for p in inspect.signature(function).parameters.values():
            if p.kind is p.VAR_KEYWORD:
                self.takes_rest = True
            elif p.kind in (p.VAR_POSITIONAL, p.POSITIONAL_ONLY):
                raise TypeError(f"{function.__name__}: arguments are bound by name, so {p.name} cannot be")
            else:
                self.named[p.name] = p.default is p.empty

    def inputs(self, columns: list[str]) -> dict[str, str]:
        """Column of each argument that is passed."""
        bound = {}
        for name, needed in self.named.items():
            column = CALL_LISTS.get(name, name)
            if column in columns:
                bound[name] = column
            elif needed:
                raise ValueError(f"{self.function.__name__} needs a column {column}")
        if self.takes_rest:
            lists = {c: n for n, c in CALL_LISTS.items()}
            bound.update((lists.get(c, c), c) for c in columns if c not in bound.values())
        return bound

    def __call__(self, lists: dict[str, list], bound: dict[str, str], rows: int) -> list[float | None]:
        out = list(self.function(**{name: lists[column] for name, column in bound.items()}))
        if len(out) != rows:
            raise ValueError(f"{self.function.__name__} gave {len(out)} rewards for {rows} completions")
        return [None if x is None else float(x) for x in out]


class RewardSet:
    """User-supplied rewards, summed.

    A reward is a function of columns that returns a column: built from native functions,
    or a pandas UDF around any Python code. Or it is a plain Python function over lists, which
    runs on bounded batches of rows or, given ``per_call``, on all rows of one training call.
    """

    def __init__(self) -> None:
        self._rewards: dict[str, tuple[Callable[..., Column], tuple[str, ...], float]] = {}
        self._functions: dict[str, tuple[PythonReward, float]] = {}

    def add(self, name: str, reward: Callable[..., Column], *inputs: str, weight: float = 1.0) -> "RewardSet":
        self._rewards[name] = (reward, inputs or ("completion",), weight)
        return self

    def add_function(self, function: Callable[..., list[float | None]], name: str | None = None, weight: float = 1.0) -> "RewardSet":
        """Add a function ``(prompts, completions, ..., **columns) -> list of numbers`` as it is."""
        self._functions[name or function.__name__] = (PythonReward(function), weight)
        return self

    def apply(self, completions: DataFrame, keep: list[str], total: str = "total_reward", per_call: str | None = None) -> DataFrame:
        """The columns ``keep``, each reward by its name, and the sum of those that are there.

        ``per_call`` names the column of the training call: functions then get whole calls, whose
        size is that of a training batch.
        """
        terms = {
            name: weight * reward(*[F.col(i) for i in inputs])
            for name, (reward, inputs, weight) in self._rewards.items()
        }
        if not self._functions:
            scored = completions.select(*keep, *[term.alias(name) for name, term in terms.items()])
        else:
            scored = self._called(completions, keep, terms, per_call)
        names = [*terms, *self._functions]
        return scored.withColumn(total, sum((F.coalesce(F.col(n), F.lit(0.0)) if n in self._functions else F.col(n) for n in names), F.lit(0.0)))

    def _called(self, completions: DataFrame, keep: list[str], terms: dict[str, Column], per_call: str | None) -> DataFrame:
        columns = completions.columns
        bound = {name: f.inputs(columns) for name, (f, _) in self._functions.items()}
        read = sorted({c for b in bound.values() for c in b.values()})
        # What is kept and the native terms pass by in one struct, so that names cannot clash.
        kept = F.struct(*[F.col(c) for c in keep], *[t.alias(n) for n, t in terms.items()])
        asked = completions.select(kept.alias(_KEPT), *read, *([F.col(per_call).alias(_PLACE)] if per_call else []))
        kind, functions = asked.schema[_KEPT].dataType.simpleString(), self._functions

        def score_batch(batch: pa.RecordBatch | pa.Table) -> list[pa.Array]:
            lists = {c: batch.column(c).to_pylist() for c in read}
            rewards = []
            for name, (function, weight) in functions.items():
                values = function(lists, bound[name], batch.num_rows)
                rewards.append(pa.array([None if v is None else weight * v for v in values], pa.float64()))
            return rewards

        schema = f"{_KEPT} {kind}, " + ", ".join(f"`{n}` double" for n in functions)
        if per_call:
            def run_call(call: pa.Table) -> pa.Table:
                return pa.table([call.column(_KEPT), *score_batch(call)], names=[_KEPT, *functions])

            scored = asked.groupBy(_PLACE).applyInArrow(run_call, schema)
        else:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield pa.RecordBatch.from_arrays([batch.column(_KEPT), *score_batch(batch)], names=[_KEPT, *functions])

            scored = asked.mapInArrow(run, schema)
        return scored.select(f"{_KEPT}.*", *functions)
