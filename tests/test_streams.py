"""Streams in several micro-batches equal the batch operators."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywork.operators import logs, throttle, votes
from tallywork.plans.inputs import read_input
from tallywork.plans.log_queries import cut_pieces
from tallywork.session import run_folder
from tallywork.streaming import generations, live_votes
from tallywork.streaming.runs import BUCKETS, run_available, split_late, state_settings, stream_files

SF = "/root/testdata/sf0.001"
EPOCH = 1_700_000_000


def in_files(spark, df, order, files):
    """``df`` written as one file per part of the order, read back as one micro-batch each."""
    folder = run_folder(spark, "parts")
    numbered = df.withColumn("__part", F.ntile(files).over(Window.orderBy(order))).cache()
    for i in range(1, files + 1):
        numbered.where(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(folder)
    return stream_files(spark, folder, files_per_batch=1)


@pytest.fixture(scope="module")
def answers(spark):
    rows = read_input(spark, SF, "answers").where("generation_id < 400")
    return rows.withColumn("ts", F.timestamp_seconds(F.col("arrival") + EPOCH))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def asked(spark, answers, deadline):
    """The questions answered, those of even numbers with half the time, and one without an answer."""
    ids = answers.select("question_id").distinct().union(spark.range(-5, -4))
    return ids.select("question_id", (F.lit(deadline) / (2 - F.coalesce("question_id", F.lit(0)) % 2)).alias("deadline"))


def with_clock(answers, *times):
    """Answers, and ticks of the clock behind them."""
    started = answers.drop("ts").withColumn("started", F.timestamp_seconds(F.lit(EPOCH)))
    clock = answers.sparkSession.createDataFrame([(t,) for t in times], "t bigint").select(F.timestamp_seconds(F.col("t") + EPOCH).alias("started"))
    return started.unionByName(clock, allowMissingColumns=True)


def stopped(spark, timed, questions, files, **options):
    order = F.coalesce(F.col("arrival"), F.unix_seconds("started"))
    stops = live_votes.early_stop(in_files(spark, timed, order, files), questions, "1 second", **options)
    return live_votes.with_unanswered(questions, run_available(stops, "stops"))


def test_votes_in_any_order(spark, answers):
    stream = in_files(spark, answers, F.md5(F.col("generation_id").cast("string")), 3)
    live = live_votes.latest_votes(run_available(live_votes.live_votes(stream), "live"))
    valid = votes.vote_frequencies(answers).where("highest > 0")
    assert rows_of(live, "question_id", "highest", "second", "third") == rows_of(valid, *valid.columns)
    majority = votes.majority_answer(answers).where("answer IS NOT NULL")
    assert rows_of(live, "question_id", "answer") == rows_of(majority, *majority.columns)


def test_early_stop_over_ordered_batches(spark, answers):
    questions = asked(spark, answers, 130)
    stops = stopped(spark, with_clock(answers, 5000, 9000), questions, 4)
    want = votes.early_stop_tick(questions, answers)
    assert rows_of(stops, *want.columns) == rows_of(want, *want.columns)


def test_poll_counts_with_updates(spark, answers):
    stream = in_files(spark, answers, F.col("arrival"), 3)
    counts = live_votes.poll_counts(stream, "1 minute").select(F.unix_seconds("poll.end").alias("poll"), "method", "arrived")
    got = run_available(counts, "polls", "update").groupBy("poll", "method").agg(F.max("arrived").alias("arrived"))
    want = answers.groupBy((F.floor(F.col("arrival") / 20) * 20 + 20 + EPOCH).alias("poll"), "method").agg(F.count("*").alias("arrived"))
    assert rows_of(got, "poll", "method", "arrived") == rows_of(want, "poll", "method", "arrived")


def test_generations_from_shuffled_chunks(spark):
    chunks = cut_pieces(read_input(spark, SF, "turns").where("generation_id < 8"))
    chunks = chunks.withColumn("ts", F.timestamp_seconds(F.col("chunk_idx") + EPOCH))
    stream = in_files(spark, chunks, F.md5(F.concat_ws("-", "generation_id", "request_counter", "chunk_idx")), 3)
    done = run_available(generations.assemble_generations(stream, delay="1 day", idle="1 day"), "done")
    full = {(r[0], r[1]): r[2] for r in logs.request_texts(chunks).collect()}
    rows = done.collect()
    assert {(r.generation_id, r.request_counter) for r in rows} == set(full) and len(rows) == len(full)
    for r in rows:
        text = full[r.generation_id, r.request_counter]
        assert text.startswith(r.text) and (r.reason != "stop_token" or r.text == text)
    assert {r.reason for r in rows} == {"boxed", "code_block", "stop_token"}


CHECKS = "question_id bigint, arrival bigint, ts timestamp"


def keep(stream, home):
    return run_available(generations.throttle(stream, "question_id", "arrival", "130 seconds"), "kept", "append", 2, f"{home}/kept")


def test_throttle_over_batches_in_any_order(spark, answers):
    """Micro-batches out of order within the delay give what the batch operator gives."""
    checks = answers.select("question_id", "arrival", "ts")
    clock = spark.createDataFrame([(None, None, at(9000 * (i + 1))) for i in range(2)], CHECKS)
    mixed = F.when(F.col("arrival").isNull(), F.unix_seconds("ts")).otherwise(F.floor(F.col("arrival") / 60) * 60 + F.pmod(F.xxhash64("question_id", "arrival"), F.lit(120)))
    stream = in_files(spark, checks.unionByName(clock), mixed, 5)
    kept = run_available(generations.throttle(stream, "question_id", "arrival", "10 minutes"), "throttle")
    want = throttle.throttled_checks(answers, "question_id", "arrival")
    assert rows_of(kept, "question_id", "arrival") == rows_of(want, "question_id", "arrival")


def test_checks_wait_for_earlier_ones_over_restarts(spark):
    rows = [[(1, 10, at(10)), (1, 20, at(20)), (None, 11, at(11))], [(1, 15, at(15)), (1, 30, at(30)), (None, 7, at(7)), (None, 12, at(12))], [(None, None, at(5000))], [(None, None, at(9999))]]
    kept = waves(spark, "throttled", rows, CHECKS, keep)
    assert rows_of(kept, "question_id", "arrival") == sorted([(1, 10), (1, 15), (1, 20), (1, 30), (None, 7), (None, 12)], key=repr)


def test_a_key_forgets_after_its_idle_time_only(spark):
    rows = [[(1, 10, at(10))], [(1, 600, at(600)), (2, 601, at(601))], [(1, 603, at(603)), (2, 604, at(604)), (2, 606, at(606))], [(None, None, at(9000))], [(None, None, at(18000))], [(None, None, at(27000))]]
    assert rows_of(waves(spark, "idle-keys", rows, CHECKS, keep), "question_id", "arrival") == [(1, 10), (1, 600), (2, 601), (2, 606)]


def test_late_flags_on_a_stream(spark, answers):
    closes = votes.early_stop_tick(asked(spark, answers, 130), answers).select("question_id", (F.col("tick") * 20).alias("closed_at"))
    stream = in_files(spark, answers, F.col("arrival"), 2)
    flagged = run_available(votes.late_results(stream, closes), "late")
    want = votes.late_results(answers, closes)
    assert rows_of(flagged, "generation_id", "late", "reason") == rows_of(want, "generation_id", "late", "reason")


def test_a_large_question_is_thinned_without_loss(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["math", "code"]), i % 60, str(rng.randint(0, 300))) for i in range(1500)]
    rows += [(2, 2000, "code", 10, "x"), (2, 2001, "code", 30, "0"), (2, 2002, "code", 30, "")]
    df = spark.createDataFrame(rows, "question_id bigint, generation_id bigint, method string, arrival bigint, answer string")
    timed = df.withColumn("started", F.timestamp_seconds(F.lit(EPOCH))).withColumn("ts", F.timestamp_seconds(F.col("arrival") + EPOCH))
    live = live_votes.latest_votes(run_available(live_votes.live_votes(in_files(spark, timed, F.col("arrival"), 2)), "live"))
    want = votes.vote_frequencies(df)
    assert rows_of(live, *want.columns) == rows_of(want, *want.columns)
    assert rows_of(live, "question_id", "votes", "answer") == [
        (1, 1500, votes.majority_answer(df).where("question_id = 1").first().answer), (2, 1, 0),
    ]
    questions = spark.createDataFrame([(1, 40), (2, 40)], "question_id bigint, deadline bigint")
    stops = stopped(spark, with_clock(timed, 900, 9000), questions, 3, enough_math=10**6, full_count=-1)
    batch = votes.early_stop_tick(questions, df, enough_math=10**6, full_count=-1)
    assert rows_of(stops, *batch.columns) == rows_of(batch, *batch.columns)


VOTES = "question_id bigint, generation_id bigint, method string, answer string, ts timestamp, closes timestamp"


def waves(spark, label, rows, schema, run):
    """Deliver lists of rows one after another, ``run`` started anew on each; the last result."""
    folder = run_folder(spark, label)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/input/wave={i}")
        empty = spark.createDataFrame([], schema)
        result = run(stream_files(spark, f"{folder}/input/wave=*", schema=empty.schema), folder)
    return result


def at(seconds):
    return datetime.fromtimestamp(EPOCH + seconds)


def test_late_rows_are_kept_and_a_restart_goes_on(spark):
    rows = [[(1, 1, "math", "5", at(0), None), (1, 2, "math", "5", at(100), None)], [(1, 3, "math", "5", at(70), None), (1, 4, "math", "5", at(69), None)],
            [(1, 5, "math", "5", None, None), (1, 6, "math", "5", at(300), None)], [(1, 7, "math", "5", at(100), None)]]
    in_time, late = waves(spark, "late", rows, VOTES, lambda s, home: split_late(s, "ts", "30 seconds", "split", f"{home}/split"))
    assert sorted((r.generation_id, r.batch, r.late) for r in late.collect()) == [(4, 1, True), (7, 3, True)]
    kept = run_available(in_time, "kept")
    assert sorted(r.generation_id for r in kept.collect()) == [1, 2, 3, 5, 6]


def test_one_query_stops_over_restarts_and_late_polls(spark):
    """A poll is judged once it is complete, whatever came out of order, also by a query started anew."""
    schema = "question_id bigint, method string, answer string, arrival bigint, started timestamp"
    zero, questions = at(0), spark.createDataFrame([(1, 100), (2, 60), (None, 100), (4, 40)], "question_id bigint, deadline bigint")
    rows = [
        [(1, "code", "5", 50, zero), (2, "code", "8", 10, zero), (None, "math", "3", 5, zero)],
        [(1, "code", "5", 30, zero), (None, "math", "3", 25, zero), (2, "code", "9", 300, zero)],
        [(1, "code", "6", 35, zero), (7, "code", "1", 5, zero)], [(None, None, None, None, at(4000))], [(None, None, None, None, at(9000))],
    ]

    def stop(stream, home):
        return run_available(live_votes.early_stop(stream, questions, "60 seconds"), "stops", "append", 2, f"{home}/stops")

    stops = live_votes.with_unanswered(questions, waves(spark, "stops", rows, schema, stop))
    answers = spark.createDataFrame([(q, i, m, a, x) for i, (q, m, x, a, _) in enumerate(r for w in rows[:3] for r in w)], "question_id bigint, generation_id bigint, method string, arrival bigint, answer string")
    want = votes.early_stop_tick(questions, answers)
    assert rows_of(stops, *want.columns) == rows_of(want, *want.columns) and want.where("reason = 'math_agrees' AND question_id IS NULL").count() == 1


def test_counts_go_on_after_a_long_silence(spark):
    week = 7 * 86_400

    def vote(stream, home):
        return run_available(live_votes.live_votes(stream), "live", "append", 2, f"{home}/live")

    rows = [[(1, i, "math", "5", at(i), None) for i in range(4)] + [(None, 9, "code", "7", at(1), None)], [(1, 5, "math", "5", at(week), None)], [(1, 6, "math", "5", at(10), None)]]
    live = live_votes.latest_votes(waves(spark, "silence", rows, VOTES, vote))
    assert sorted(((r.question_id, r.votes, r.highest) for r in live.collect()), key=str) == [(1, 6, 6), (None, 1, 1)]


def test_a_vote_after_the_close_does_not_count(spark):
    def vote(stream, home):
        return run_available(live_votes.live_votes(stream, until="closes", delay="10 seconds"), "live", "append", 2, f"{home}/live")

    rows = [[(1, 1, "math", "5", at(1), at(50)), (2, 2, "math", "6", at(2), at(900))], [(1, 3, "math", "7", at(400), at(50)), (2, 4, "code", "6", at(400), at(900))],
            [(2, 5, "code", "6", at(800), at(900))]]
    live = live_votes.latest_votes(waves(spark, "close", rows, VOTES, vote))
    assert sorted((r.question_id, r.votes, r.highest, r.answer) for r in live.collect()) == [(1, 1, 1, 5), (2, 3, 3, 6)]


def test_an_idle_request_keeps_what_has_come(spark):
    schema = "generation_id bigint, request_counter bigint, method string, chunk_idx bigint, chunk string, is_last boolean, ts timestamp"

    def assemble(stream, home):
        done = generations.assemble_generations(stream, delay="10 seconds", idle="60 seconds")
        return run_available(done, "done", "append", 2, f"{home}/done")

    rows = [[(1, 1, "math", 0, "a", False, at(0)), (1, 1, "math", 3, "d", True, at(1)), (1, 1, "math", 2, "c", False, at(1)), (2, 1, "math", 0, "x", False, at(0))],
            [(9, 1, "math", 0, "", True, at(500))], [(9, 2, "math", 0, "", True, at(501))], [(9, 3, "math", 0, "", True, at(5000))]]
    done = waves(spark, "idle", rows, schema, assemble)
    got = sorted((r.generation_id, r.text, r.chunks, r.reason, r.missing) for r in done.collect() if r.generation_id < 9)
    assert got == [(1, "acd", 3, "expired", 1), (2, "x", 1, "expired", None)]


def test_first_filled_block_ends_a_request(spark):
    schema = "generation_id bigint, request_counter bigint, method string, chunk_idx bigint, chunk string, is_last boolean, ts timestamp"
    text = "```python\n```  ``` ```python ``` ```python\nx = 1\n``` ```python ``` end"
    for size in (1, 3, 7, 100):
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        rows = [[(1, 1, "code", i, p, i + 1 == len(parts), at(i)) for i, p in enumerate(parts)]]
        done = waves(spark, "blocks", rows, schema, lambda s, home: run_available(generations.assemble_generations(s, "1 day", "1 day"), "d", "append", 2, f"{home}/d"))
        row = done.first()
        end = text.index("x = 1") + 9
        assert (row.reason, row.chunks, row.text) == ("code_block", -(-end // size), text[: -(-end // size) * size])


def test_python_is_called_per_bucket_and_not_per_key(spark):
    """States are as many as buckets, however many questions and values there are."""
    rows = spark.range(900).selectExpr("id AS question_id", "'math' AS method", "string(id % 700) AS answer", "id % 50 AS arrival")
    timed = rows.withColumns({"started": F.timestamp_seconds(F.lit(EPOCH)), "ts": F.timestamp_seconds(F.col("arrival") + EPOCH)})
    folder = run_folder(spark, "buckets")
    timed.coalesce(1).write.parquet(folder)
    questions = rows.select("question_id", F.lit(100).alias("deadline"))
    flows = {
        "votes": lambda stream: live_votes.live_votes(stream), "stops": lambda stream: live_votes.early_stop(stream, questions, "1 second"),
        "throttle": lambda stream: generations.throttle(stream, "question_id", "arrival", "1 second"),
    }
    for name, flow in flows.items():
        with state_settings(spark, 2):
            query = flow(stream_files(spark, folder)).writeStream.format("noop").option("checkpointLocation", run_folder(spark, name)).trigger(availableNow=True).start()
        query.awaitTermination()
        operators = query.recentProgress[0]["stateOperators"]
        assert 0 < max(o["numRowsUpdated"] for o in operators) <= 2 * BUCKETS, name


CHUNKS = "generation_id bigint, request_counter bigint, method string, chunk_idx bigint, chunk string, is_last boolean, ts timestamp"


def test_requests_are_assembled_per_bucket_and_not_per_key(spark):
    rows = spark.range(1800).selectExpr("id % 900 AS generation_id", "1L AS request_counter", "'math' AS method", "id div 900 AS chunk_idx", "'a' AS chunk", "id >= 900 AS is_last")
    folder = run_folder(spark, "requests")
    rows.withColumn("ts", F.timestamp_seconds(F.col("chunk_idx") + EPOCH)).coalesce(1).write.parquet(folder)
    done = generations.assemble_generations(stream_files(spark, folder), "1 day", "1 day", buckets=16)
    with state_settings(spark, 2):
        query = done.writeStream.format("noop").option("checkpointLocation", run_folder(spark, "assembled")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(o["numRowsUpdated"] for o in query.recentProgress[0]["stateOperators"]) <= 2 * 16


def test_odd_chunks_are_put_together_over_restarts(spark):
    """Chunks that come twice, at the watermark's own time, of missing keys, without a text, behind an end, or after it."""
    def assemble(stream, home):
        return run_available(generations.assemble_generations(stream, "10 seconds", "60 seconds"), "odd", "append", 2, f"{home}/odd")

    rows = [
        [(1, 1, "math", 0, "a", False, at(95)), (1, 1, "math", 2, "c", False, at(95)), (2, 1, "x=math", 0, "oxed{1}", False, at(100)), (2, 1, "x=math", 1, None, True, at(100)),
         (None, 1, "math", 0, "oxed{", False, at(95)), (1, None, "math", 0, "p", False, at(95)), (3, 1, None, 0, "q", True, at(95)), (3, 1, None, 1, "r", True, at(95))],
        [(1, 1, "math", 0, "a", False, at(95)), (1, 1, "math", 2, "C", False, at(95)), (None, 1, "math", 1, "5}6", False, at(90)), (1, None, "math", 1, "", True, at(90)), (3, 1, None, 0, "q", True, at(95)),
         (4, 1, "code", 0, "```python" + " " * 4000 + "`", False, at(95)), (4, 1, "code", 1, "``", True, at(95))],
        [(9, 1, "math", 0, "", True, at(500))], [(9, 2, "math", 0, "", True, at(900))], [(9, 3, "math", 0, "", True, at(5000))],
    ]
    done = waves(spark, "odd", rows, CHUNKS, assemble).where("coalesce(generation_id, 0) < 9")
    assert rows_of(done, "generation_id", "request_counter", "method", "text", "chunks", "reason", "missing", "answer") == sorted([
        (1, 1, "math", "aC", 2, "expired", 1, ""), (2, 1, "x=math", "oxed{1}", 2, "stop_token", None, "1"), (None, 1, "math", "oxed{5}6", 2, "boxed", None, "5"),
        (1, None, "math", "p", 2, "stop_token", None, ""), (3, 1, None, "q", 1, "stop_token", None, ""), (4, 1, "code", "```python" + " " * 4000 + "```", 2, "stop_token", None, ""),
    ], key=repr)


def test_an_end_is_found_in_the_chunk_that_completes_it():
    """Whatever the chunks, the first filled block or box is the one found in the whole text."""
    chance = random.Random(3)
    whole = {False: re.compile(r"```python\s*(.*?)\s*```", re.DOTALL), True: re.compile(r"oxed\{([^}\n]+)\}")}
    for i in range(3000):
        math = i % 2 == 0
        text = "".join(chance.choices(["oxed{", "oxed", "{", "}", "7", "\n"] if math else ["```python", "```", "`", "python", " ", "\n", "x"], k=chance.randint(1, 14)))
        want = next((m.end() for m in whole[math].finditer(text) if m[1]), -1)
        got, known, scan = -1, 0, 0
        while known < len(text) and got < 0:
            upto = known + chance.randint(1, 6)
            got, scan = generations.ended(math, text[:upto], known, scan)
            known = upto
        assert got == want, text


def test_pieces_are_the_text_in_order(spark):
    texts = ["", None, "a" * 16, "b" * 17, "\U0001f600" * 20 + "\r\n x", "\n" * 33]
    turns = spark.createDataFrame([(i, 0, "math", t) for i, t in enumerate(texts)], "generation_id bigint, request_counter bigint, method string, text string")
    got = {}
    for r in cut_pieces(turns).orderBy("generation_id", "chunk_idx").collect():
        got.setdefault(r.generation_id, []).append((r.chunk_idx, r.chunk, r.is_last))
    for i, t in enumerate(texts):
        pieces = [t[at : at + 16] for at in range(0, len(t), 16)] if t else [t]
        assert got[i] == [(n, p, n + 1 == len(pieces)) for n, p in enumerate(pieces)]
