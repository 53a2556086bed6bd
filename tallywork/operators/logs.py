"""Generation logs: union, flags, answers, order.

A run is (question_id, method, generation_idx, defer_count); its requests are numbered by
request_counter and its last record has the reason 'final' or 'terminated'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.functions.answers import DEFAULT_ANSWER
from tallywork.operators.joins import join_on

RUN = ["question_id", "method", "generation_idx", "defer_count"]
LOG_ORDER = ["question_id", "generation_idx", "defer_count", "log_time", "method"]
LOG_SCHEMA = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("generation_idx", T.LongType()),
        T.StructField("defer_count", T.LongType()),
        T.StructField("request_counter", T.LongType()),
        T.StructField("token_counter", T.LongType()),
        T.StructField("log_time", T.DoubleType()),
        T.StructField("elapsed", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("flag_for_training", T.BooleanType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("buffer", T.StringType()),
        T.StructField("new_buffer", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("injected", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("eventual_answer", T.StringType()),
        T.StructField("correct_answer", T.StringType()),
    ]
)


def final_logs(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("reason") == "final")


def training_logs(logs: DataFrame) -> DataFrame:
    return logs.where("flag_for_training")


CLOSING = ("final", "terminated")


def closings(logs: DataFrame) -> DataFrame:
    """The records that end a run, usually one for each."""
    return logs.where(F.col("reason").isin(*CLOSING))


def last_ends(ends: DataFrame, *columns: str) -> DataFrame:
    """One row per run with ``columns`` of its latest end, of equal times the one of the greatest values.

    Records without a log_time are ordered by their request.
    """
    time = "log_time" if "log_time" in ends.columns else "request_counter"
    latest = F.max(F.struct(F.col(time).alias("__time"), *columns))
    return ends.groupBy(*RUN).agg(latest.alias("__end")).select(*RUN, *(F.col(f"__end.{c}").alias(c) for c in columns))


def normalize_logs(*records: DataFrame, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Records with differing columns in one table of fixed columns, NULL where missing."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)
    return merged.select(
        *[
            (F.col(f.name) if f.name in merged.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def union_question_logs(*logs: DataFrame) -> DataFrame:
    """Logs of several questions in one table."""
    return reduce(DataFrame.unionByName, logs)


def fill_eventual_answer(logs: DataFrame) -> DataFrame:
    """The run's answer on each of its records, '-1' where it is empty, NULL while the run has no end.

    Of a run with several ends the latest counts.
    """
    answer = F.coalesce(F.col("answer"), F.lit(""))
    ends = last_ends(closings(logs), "answer").select(*RUN, F.when(answer == "", "-1").otherwise(answer).alias("eventual_answer"))
    return join_on(logs, ends, RUN, "left")


def training_flag(requests: DataFrame) -> DataFrame:
    """Request k is a training row if request k - 1 of its run ended with a terminal execution.

    The record that closes a run is never one, though it has the number of the last request.
    Looked up by request number, so a very long run is spread over tasks.
    """
    marked = requests.where(F.col("reason") == "terminal_code_execution").select(
        *RUN, (F.col("request_counter") + 1).alias("request_counter"), F.lit(True).alias("training_flag")
    ).distinct()
    flagged = join_on(requests, marked, [*RUN, "request_counter"], "left")
    request = ~F.coalesce(F.col("reason").isin(*CLOSING), F.lit(False))
    return flagged.withColumn("training_flag", F.coalesce("training_flag", F.lit(False)) & request)


def attach_correct_answer(logs: DataFrame, problems: DataFrame, key: str = "question_id") -> DataFrame:
    """Known answer as text, '' if the question is unknown. Of duplicate problems the last counts."""
    known = problems.groupBy(key).agg(F.max_by("answer", "position").cast("string").alias("correct_answer"))
    return logs.join(known, key, "left").withColumn("correct_answer", F.coalesce("correct_answer", F.lit("")))


def arrival_times(ends: DataFrame) -> DataFrame:
    """Arrival since the question started: a hand-over run starts its clock when its parent ends.

    A parent with several ends counts with the latest.
    """
    other = F.when(F.col("method") == "code", "math").when(F.col("method") == "math", "code")
    parents = last_ends(ends, "log_time").select(
        "question_id", other.alias("method"), "generation_idx", (F.col("defer_count") + 1).alias("defer_count"), F.col("log_time").alias("parent_time"),
    )
    return join_on(ends, parents, RUN, "left").select(
        *RUN, (F.coalesce("parent_time", F.lit(0.0)) + F.col("log_time")).alias("arrival")
    )


def sorted_logs(logs: DataFrame) -> DataFrame:
    """A range-partitioned sort; missing values come last."""
    return logs.orderBy(*[F.asc_nulls_last(c) for c in LOG_ORDER])


def generation_outcome(ends: DataFrame, problems: DataFrame) -> DataFrame:
    """Right, wrong or no answer, counted per method and hand-over depth; 'unknown' if no correct answer is known."""
    judged = attach_correct_answer(last_ends(ends, "answer"), problems)
    answer = F.coalesce(F.col("answer"), F.lit(""))
    outcome = (
        F.when(answer == "", "none").when(F.col("correct_answer") == "", "unknown")
        .when(answer == F.col("correct_answer"), "right").otherwise("wrong")
    )
    return judged.groupBy("method", "defer_count", outcome.alias("outcome")).agg(F.count("*").alias("runs"))


def generation_counters(chunks: DataFrame) -> DataFrame:
    """Requests and chunks per generation."""
    return chunks.groupBy("generation_id").agg(
        F.max("request_counter").alias("last_request"),
        F.sum((F.col("chunk_idx") == 0).cast("bigint")).alias("requests"),
        F.count("*").alias("chunks"),
    )


def request_texts(chunks: DataFrame) -> DataFrame:
    """Each request's text, its chunks joined in order."""
    pieces = F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk")))
    return chunks.groupBy("generation_id", "request_counter").agg(
        F.array_join(F.transform(pieces, lambda p: p["chunk"]), "").alias("text")
    )


def folded_prompts(chunks: DataFrame) -> DataFrame:
    """Per generation: all its text once, and ``ends``: of each request, how many characters its prompt has.

    The size is that of the generation, however many requests it has. Chunks are shuffled by
    generation, which serves the grouping by request as well; the text of one generation has to
    fit a model's context, so it fits a row.
    """
    parts = F.array_sort(F.collect_list(F.struct("request_counter", "text")))
    gathered = request_texts(chunks.repartition("generation_id")).groupBy("generation_id").agg(parts.alias("parts"))
    ends = F.transform(
        "parts", lambda p, i: F.struct(
            p["request_counter"].alias("request_counter"),
            F.aggregate(F.slice("parts", 1, i + 1), F.lit(0).cast("bigint"), lambda total, q: total + F.length(q["text"])).alias("end"),
        ),
    )
    return gathered.select("generation_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), ends.alias("ends"))


def prompts_at(folded: DataFrame, chosen: Column | None = None) -> DataFrame:
    """The prompts (generation_id, request_counter, prompt) of ``folded_prompts``, of the requests that ``chosen`` selects."""
    requests = folded.select("generation_id", "text", F.inline("ends"))
    picked = requests if chosen is None else requests.where(chosen)
    return picked.select("generation_id", "request_counter", F.left("text", F.col("end").cast("int")).alias("prompt"))


def running_prompt(chunks: DataFrame) -> DataFrame:
    """All text of a generation up to and including each request, repeated as that asks for."""
    return prompts_at(folded_prompts(chunks))


# ---- Problem tables -----------------------------------------------------------------


DIGITS = 4


def sample_problems(problems: DataFrame, limit: int, seed: int = 43, few: int = 10_000) -> DataFrame:
    """A repeatable sample of at most ``limit`` problems: those of the least seeded digests, then ids.

    A histogram over the first digits of the digests tells where the sample ends, a finer one
    within the bin that it cuts, until that holds only ``few``. Rows are then judged one by one, and only
    those of the last bin are sorted, so a sample of any size is spread over tasks.
    """
    name = "__mixed"
    mixed = F.coalesce(F.md5(F.concat(F.col("id"), F.lit(f"-{seed}")).cast("binary")), F.lit(""))
    rows = problems.withColumn(name, mixed)
    head, wanted = "", limit
    while True:
        inside = rows.where(F.startswith(name, F.lit(head)))
        counts = inside.groupBy(F.substring(name, len(head) + 1, DIGITS).alias("bin")).count().orderBy("bin").collect()
        for row in counts:
            if row["count"] > wanted:
                break
            wanted -= row["count"]
        else:
            return problems
        head += row["bin"]
        # A bin without digits is that of equal digests.
        if row["count"] <= few or not row["bin"]:
            break
    last = rows.where(F.startswith(name, F.lit(head)) if head else F.col(name) == "").orderBy(name, "id").limit(wanted)
    return rows.where(F.col(name) < head).unionByName(last).drop(name)


def select_questions(problems: DataFrame, keywords: list[str], default: int = DEFAULT_ANSWER) -> DataFrame:
    """Only questions with a keyword are worked on; the others get the default answer."""
    hit: Column = reduce(lambda a, b: a | b, [F.contains(F.col("problem"), F.lit(k)) for k in keywords])
    return problems.withColumn("preset_answer", F.when(~hit, F.lit(default).cast("bigint")))
