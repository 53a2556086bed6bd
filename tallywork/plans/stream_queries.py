"""Streams over the given tables, delivered in waves.

Each wave is written and then read by the same queries started anew, which go on where they
ended. Some answers come with a later wave than their time; those beyond the delay are late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators.joins import join_on
from tallywork.plans.inputs import PIECE, read_input, with_inputs
from tallywork.plans.log_queries import cut_pieces
from tallywork.plans.registry import query
from tallywork.plans.text_queries import BOX_LAST, REDACTED
from tallywork.plans.vote_queries import FLOOR_MOD, STOPS, TOP3, VALUED, deadlines
from tallywork.session import run_folder
from tallywork.streaming import generations, live_votes
from tallywork.streaming.runs import run_available, split_late, stream_files

EPOCH = 1_700_000_000
DELAY = "130 seconds"
# These streams are small; a large one keeps the session's number of shuffle partitions.
PARTITIONS = 8

# Some come a wave late, which is within the delay, and some too late.
WAVE = """CASE WHEN generation_id % 40 = 7 AND arrival < 100 THEN 2 WHEN generation_id % 20 = 3 THEN least(floor(arrival / 120) + 1, 2)
               ELSE least(floor(arrival / 120), 2) END"""
IN_TIME = f"""
waves AS (SELECT *, {WAVE} AS wave FROM fx_answers),
newest AS (SELECT wave, max(max(arrival)) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
           FROM waves GROUP BY wave),
in_time AS (SELECT waves.* FROM waves JOIN newest USING (wave) WHERE newest IS NULL OR arrival >= newest - 130)
"""


def _timely(sql: str) -> str:
    return sql.replace("fx_answers", "in_time")


def in_waves(spark, rows: DataFrame, count: int, delay: str, then: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Deliver ``rows`` by their ``wave``, with ``then`` run on what is in time; its last result, and what was late."""
    folder = run_folder(spark, "waves")
    plain = rows.drop("wave")
    for i in range(count):
        rows.where(F.col("wave") == i).select(plain.columns).write.parquet(f"{folder}/input/wave={i}")
        stream = stream_files(spark, f"{folder}/input/wave=*", schema=plain.schema)
        in_time, late = split_late(stream, "ts", delay, "split", f"{folder}/split")
        result = then(in_time, folder)
    return result, late


def _answers(spark, folder):
    answers = read_input(spark, folder, "answers")
    return answers.withColumns({"ts": F.timestamp_seconds(F.col("arrival") + EPOCH), "wave": F.expr(WAVE)})


def _clock(spark, first):
    """Two ticks of the clock behind all answers, in waves from ``first`` on."""
    return spark.range(2).select((F.col("id") + first).alias("wave"), F.timestamp_seconds((F.col("id") + 1) * 10_000 + EPOCH).alias("ts"))


@query("poll_counts_stream", with_inputs(f"""
WITH {IN_TIME} SELECT CAST(arrival // 20 + 1 AS BIGINT) AS poll, method, count(*) AS arrived FROM in_time GROUP BY ALL""", "answers"))
def poll_counts_stream(spark, folder):
    def count(answers, home):
        counts = live_votes.poll_counts(answers, DELAY).select(
            F.floor((F.unix_seconds("poll.end") - EPOCH) / 20).alias("poll"), "method", "arrived"
        )
        return run_available(counts, "poll_counts", "update", PARTITIONS, f"{home}/polls")

    updates, _ = in_waves(spark, _answers(spark, folder), 3, DELAY, count)
    # A window's count only grows.
    return updates.groupBy("poll", "method").agg(F.max("arrived").alias("arrived"))


@query("late_answers_stream", with_inputs(f"""
WITH {IN_TIME} SELECT question_id, generation_id, method, answer, true AS late
FROM waves ANTI JOIN in_time USING (generation_id)""", "answers"))
def late_answers_stream(spark, folder):
    _, late = in_waves(spark, _answers(spark, folder), 3, DELAY, lambda answers, home: answers)
    return late.select("question_id", "generation_id", "method", "answer", "late")


@query("live_votes_stream", with_inputs(f"""
WITH {IN_TIME}, asked AS (SELECT question_id, CAST(trunc(20 + (coalesce(question_id, 0) % 37 + 1) * (400 - 20) / 37e0) AS BIGINT) AS deadline FROM fx_questions),
open AS (SELECT in_time.* FROM in_time JOIN asked ON asked.question_id IS NOT DISTINCT FROM in_time.question_id WHERE arrival <= deadline), {VALUED.replace("fx_answers", "open")}, {TOP3},
cast_votes AS (SELECT question_id, count(*) AS votes FROM valued WHERE v IS NOT NULL GROUP BY question_id)
SELECT c.question_id, votes, highest, second, third,
       ((highest >= 2 AND second <= 0 AND third <= 0) OR (highest >= 3 AND second <= 1)
        OR (highest >= 4 AND second <= 3) OR highest >= 5) AS stop, {FLOOR_MOD.format(c="v")} AS answer
FROM cast_votes c JOIN top3 t ON t.question_id IS NOT DISTINCT FROM c.question_id JOIN ranked r ON r.question_id IS NOT DISTINCT FROM c.question_id WHERE rn = 1""", "answers", "questions"))
def live_votes_stream(spark, folder):
    closing = deadlines(read_input(spark, folder, "questions")).select(
        "question_id", F.timestamp_seconds(F.col("deadline") + EPOCH).alias("closes")
    )

    def vote(answers, home):
        return run_available(live_votes.live_votes(answers, until="closes", delay=DELAY), "live_votes", "append", PARTITIONS, f"{home}/live")

    history, _ = in_waves(spark, join_on(_answers(spark, folder), closing, ["question_id"]), 3, DELAY, vote)
    return live_votes.latest_votes(history)


@query("early_stop_stream", with_inputs(f"WITH {IN_TIME}, {_timely(VALUED)}, {STOPS} SELECT * FROM stops", "answers", "questions"))
def early_stop_stream(spark, folder):
    questions = deadlines(read_input(spark, folder, "questions"))
    answers = _answers(spark, folder)
    rows = answers.withColumn("wave", F.col("wave").cast("long")).unionByName(_clock(spark, 3), allowMissingColumns=True)

    def stop(timed, home):
        started = timed.withColumn("started", F.when(F.col("arrival").isNull(), F.col("ts")).otherwise(F.timestamp_seconds(F.lit(EPOCH))))
        return run_available(live_votes.early_stop(started, questions, DELAY), "early_stop", "append", PARTITIONS, f"{home}/stops")

    stops, _ = in_waves(spark, rows, 5, DELAY, stop)
    return live_votes.with_unanswered(questions, stops)


@query("assemble_generations_stream", with_inputs(f"""
WITH boxes AS (
  SELECT generation_id, request_counter, method, text,
         length(regexp_extract(text, CASE WHEN method = 'math' THEN '(?s)^.*?oxed\\{{[^}}\\n]+\\}}'
                                          ELSE '(?s)^.*?```python\\s*[^`\\s].*?\\s*```' END)) AS stop_at FROM fx_turns),
cut AS (SELECT *, greatest(CASE WHEN stop_at > 0 THEN (stop_at + {PIECE - 1}) // {PIECE} ELSE (length(text) + {PIECE - 1}) // {PIECE} END, 1) AS n,
               greatest((length(text) + {PIECE - 1}) // {PIECE}, 1) AS whole FROM boxes),
texts AS (SELECT generation_id, request_counter, method, n AS chunks, substr(text, 1, n * {PIECE}) AS text,
       CASE WHEN stop_at = 0 THEN 'stop_token' WHEN method = 'math' THEN 'boxed' ELSE 'code_block' END AS reason,
       CAST(NULL AS BIGINT) AS missing FROM cut WHERE NOT (generation_id % 7 = 3 AND n > 1)
  UNION ALL SELECT generation_id, request_counter, method, whole - 1, substr(text, 1, {PIECE}) || substr(text, {2 * PIECE + 1}), 'expired',
       CASE WHEN whole > 2 THEN 1 END FROM cut WHERE generation_id % 7 = 3 AND n > 1)
SELECT *, CASE WHEN method = 'math' THEN {BOX_LAST.format(c='text')}
               ELSE {BOX_LAST.format(c=REDACTED.format(c='text'))} END AS answer FROM texts""", "turns"))
def assemble_generations_stream(spark, folder):
    """The second chunk of some generations never comes, and the third of others comes last."""
    chunks = cut_pieces(read_input(spark, folder, "turns")).where("NOT (generation_id % 7 = 3 AND chunk_idx = 1)")
    wave = F.when((F.col("generation_id") % 5 == 1) & (F.col("chunk_idx") == 2), 1).otherwise((F.col("chunk_idx") >= 40).cast("int"))
    chunks = chunks.withColumns({"ts": F.timestamp_seconds(F.col("chunk_idx") + EPOCH), "wave": wave.cast("long")})
    clock = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("generation_id"), F.col("id").alias("request_counter"), F.lit("code").alias("method"),
        F.lit(0).cast("bigint").alias("chunk_idx"), F.lit("").alias("chunk"), F.lit(True).alias("is_last"),
        F.timestamp_seconds((F.col("id") + 1) * 1_000_000 + EPOCH).alias("ts"), (F.col("id") + 2).alias("wave"),
    )

    def assemble(timed, home):
        done = generations.assemble_generations(timed, delay="1 hour", idle="1 day")
        return run_available(done, "generations", "append", PARTITIONS, f"{home}/done")

    done, _ = in_waves(spark, chunks.unionByName(clock), 4, "1 hour", assemble)
    return done.where("generation_id >= 0")


@query("throttle_stream", with_inputs(f"""
WITH {IN_TIME}, times AS (SELECT DISTINCT question_id, arrival FROM in_time),
next AS (SELECT a.question_id, a.arrival, min(b.arrival) AS following FROM times a
         LEFT JOIN times b ON b.question_id IS NOT DISTINCT FROM a.question_id AND b.arrival >= a.arrival + 5 GROUP BY ALL),
kept AS (SELECT question_id, min(arrival) AS arrival FROM times GROUP BY question_id
         UNION ALL SELECT n.question_id, n.following FROM kept k
         JOIN next n ON n.question_id IS NOT DISTINCT FROM k.question_id AND n.arrival = k.arrival WHERE n.following IS NOT NULL)
SELECT * FROM kept""", "answers").replace("WITH", "WITH RECURSIVE", 1))
def throttle_stream(spark, folder):
    def keep(checks, home):
        kept = generations.throttle(checks, "question_id", "arrival", DELAY, 5)
        return run_available(kept, "throttle", "append", PARTITIONS, f"{home}/kept")

    checks = _answers(spark, folder).select("question_id", "arrival", "ts", F.col("wave").cast("long").alias("wave"))
    kept, _ = in_waves(spark, checks.unionByName(_clock(spark, 3), allowMissingColumns=True), 5, DELAY, keep)
    return kept
