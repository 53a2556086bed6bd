"""Votes and early stop on a stream of answers.

Each flow is one query of two stateful operators in a chain: counts per (question, value), thinned
to what can matter, and a small state per question. A large question is spread over the parts
its values fall in. The operators' keys are buckets of many questions, so that a micro-batch calls Python
once per bucket and not per key, and what a bucket knows is a table in its state. Event-time timers
end what is known of a question when it closes (``until``). Without a closing time it stays, and
rows may come in any order and as late as they like.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywork.functions.answers import DEFAULT_ANSWER, MODULUS, answer_value, floor_mod
from tallywork.operators.joins import join_on
from tallywork.operators.votes import (
    ENOUGH_MATH, FULL_COUNT, POLL_SECONDS, agreement, last_poll, poll_tick,
)
from tallywork.streaming.runs import HeldTable, bucket_of, key_of, milliseconds, never_missing


def poll_counts(answers: DataFrame, delay: str, ts: str = "ts", poll: int = POLL_SECONDS) -> DataFrame:
    """Answers arrived per poll window and method; those later than ``delay`` belong to ``split_late``."""
    return (
        answers.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{poll} seconds").alias("poll"), "method")
        .agg(F.count("*").alias("arrived"))
    )


def _frequency(value: int, count: int) -> int:
    return (count + 1) // 2 if value == 0 else count


def _weight(value: int, count: int) -> int:
    return count if value == 0 else 2 * count


def _raised(top: list[tuple[int, int]], value: int, frequency: int) -> list[tuple[int, int]]:
    """The three highest (frequency, value) after ``value`` has reached ``frequency``.

    Frequencies only rise and every rise is reported, so three entries are enough. Reports
    may come out of order; an older one changes nothing.
    """
    reached = max([frequency, *[f for f, v in top if v == value]])
    return sorted([(reached, value), *[(f, v) for f, v in top if v != value]], reverse=True)[:3]


# ---- The operators of the chain --------------------------------------------------------

#: ``question`` and, in _ROWS, ``value`` are texts that are never missing.
#: ``ts_ms`` is a time in milliseconds not before ``ts``, for timers; ``until_ms`` lies behind the last of these.
_ROWS = "question string, value string, tick bigint, last bigint, until_ms bigint, n bigint, n_math bigint, ts timestamp, ts_ms bigint"
_COUNTS = "question string, value string, tick bigint, last bigint, until_ms bigint, n bigint, n_math bigint, all_now bigint, math_now bigint, ts timestamp"
_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]
#: Parts that a question's values fall in; a part is counted and thinned for itself.
PARTS = 64
#: No more rows than this of a question and poll are passed on as they are.
FEW = 7
#: The close of a question that has none.
NEVER = 1 << 62


def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one question, value and poll merged into one before they are shuffled."""
    for batch in batches:
        groups = batch.groupby(["question", "value", "tick"], as_index=False)
        yield groups.agg({"last": "max", "until_ms": "max", "n": "sum", "n_math": "sum", "ts": "max", "ts_ms": "max"})[list(batch.columns)]


class _Counting(StatefulProcessor):
    """Running counts of each question's values, as rows come or, by polls, once a poll is complete.

    A poll's counts wait until the watermark has passed its end. A bucket holds a table of counts
    and one of what waits, and one timer for the first time at which something is due.
    """

    def __init__(self, by_polls: bool, closes: bool):
        self.by_polls, self.closes = by_polls, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = HeldTable(handle, "seen", "question string, value string, n bigint, n_math bigint, until_ms bigint")
        self.waiting = HeldTable(handle, "waiting", "question string, value string, tick bigint, last bigint, until_ms bigint, n bigint, n_math bigint, ts_ms bigint")

    def _counted(self, rows: pd.DataFrame, now: int | None = None) -> pd.DataFrame:
        """Counts after each of ``rows``; counts of questions closed by ``now`` go."""
        seen = self.seen.get()
        each = ["question", "value"]
        every = pd.concat([seen.assign(tick=-2), rows], ignore_index=True).sort_values([*each, "tick"], kind="stable")
        every[["all_now", "math_now"]] = every.groupby(each, sort=False)[["n", "n_math"]].cumsum()
        newest = every.drop_duplicates(each, keep="last")
        if now is not None:
            newest = newest[newest["until_ms"] > now]
        self.seen.put(newest.assign(n=newest["all_now"], n_math=newest["math_now"]))
        counted = every[every["tick"] > -2]
        # With its zone, so that it is the same time in any session.
        counted = counted.assign(ts=pd.to_datetime(counted["ts_ms"].astype("int64"), unit="ms", utc=True), value=counted["value"].str[1:].where(counted["value"] != "", None))
        numbers = ["tick", "last", "until_ms", "n", "n_math", "all_now", "math_now"]
        return thinned(counted[_NAMES].astype(dict.fromkeys(numbers, "int64")).reset_index(drop=True))

    def _wait(self, waiting: pd.DataFrame) -> None:
        """A timer for what is due first."""
        due = [t["until_ms" if i else "ts_ms"].min() for i, t in enumerate((waiting, self.seen.get())) if len(t)]
        if due and min(due) < NEVER:
            self.handle.registerTimer(int(min(due)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        merged = [*rows, *([self.waiting.get()] if self.by_polls else [])]
        fresh = pd.concat([m[self.waiting.columns] for m in merged if len(m)], ignore_index=True).groupby(["question", "value", "tick"], as_index=False)
        fresh = fresh.agg({"last": "max", "until_ms": "max", "n": "sum", "n_math": "sum", "ts_ms": "max"})
        if self.by_polls:
            self.waiting.put(fresh)
            self.handle.registerTimer(int(fresh["ts_ms"].min()))
            return
        yield self._counted(fresh)
        if self.closes:
            self._wait(fresh[:0])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.waiting.get()
        complete = held["ts_ms"] <= now
        counted, rest = self._counted(held[complete], now), held[~complete]
        self.waiting.put(rest)
        self._wait(rest)
        if len(counted):
            yield counted

    def close(self) -> None:
        pass


def thinned(batch: pd.DataFrame) -> pd.DataFrame:
    """Per question and poll only the rows that can matter, the others summed into one.

    The three highest and the leader of a question are among the three highest and the
    leaders of its parts.
    """
    group = ["question", "tick"]
    many = batch.groupby(group)["n"].transform("size") > FEW
    if not many.any():
        return batch
    few, batch = batch[~many], batch[many]
    zero = batch["value"] == "0"
    marked = batch.assign(
        number=batch["value"].map(int, na_action="ignore").astype(object),
        f_all=batch["all_now"].where(~zero, (batch["all_now"] + 1) // 2),
        f_math=batch["math_now"].where(~zero, (batch["math_now"] + 1) // 2),
        weight=(2 * batch["all_now"]).where(~zero, batch["all_now"]),
    )[batch["value"].notna()]
    kept = set()
    for order, count in (("f_all", 3), ("f_math", 3), ("weight", 1)):
        kept.update(marked.sort_values([order, "number"]).groupby(group).tail(count).index)
    chosen = batch.index.isin(kept)
    totals = {"last": "max", "until_ms": "max", "n": "sum", "n_math": "sum", "ts": "max"}
    rest = batch[~chosen].groupby(group, as_index=False).agg(totals).assign(value=None, all_now=0, math_now=0)
    return pd.concat([part for part in (few, batch[chosen], rest[_NAMES]) if len(part)], ignore_index=True)


def _polled(rows: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """Questions with their rows' ``names`` by poll; a missing value is None."""
    every = pd.concat([*rows], ignore_index=True).sort_values(["question", "tick"], kind="stable")
    values = every["value"].astype(object).where(every["value"].notna(), None)
    columns = (every.assign(value=values)[c].tolist() for c in ("question", *names))
    for question, of in groupby(zip(*columns), itemgetter(0)):
        yield question, (row[1:] for row in of)


class _Voting(StatefulProcessor):
    """A question's vote so far, whenever it has changed."""

    OUT = "question string, votes bigint, highest bigint, second bigint, third bigint, leader string"

    def __init__(self, closes: bool):
        self.closes = closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = HeldTable(handle, "votes", "question string, until_ms bigint, votes bigint, frequency array<bigint>, value array<string>, weight bigint, leader string")

    def _keep(self, votes: dict[str, tuple]) -> None:
        self.held.put_rows(votes.values())
        if self.closes and votes:
            self.handle.registerTimer(min(v[1] for v in votes.values()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = {v[0]: v for v in self.held.rows()}, []
        for question, of in _polled(rows, ["until_ms", "value", "n", "all_now"]):
            _, until, votes, frequencies, values, weight, leader = held.get(question, (question, 0, 0, [], [], -1, "0"))
            top, best = list(zip(frequencies, map(int, values))), (weight, int(leader))
            for until, value, added, now in of:
                votes += added
                if value is None:
                    continue
                value = int(value)
                top = _raised(top, value, _frequency(value, now))
                best = max(best, (_weight(value, now), value))
            held[question] = (question, until, votes, [f for f, _ in top], [str(v) for _, v in top], best[0], str(best[1]))
            out.append((question, votes, *([f for f, _ in top] + [0, 0, 0])[:3], str(best[1])))
        self._keep(held)
        yield pd.DataFrame(out, columns=["question", "votes", "highest", "second", "third", "leader"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self._keep({v[0]: v for v in self.held.rows() if v[1] > now})
        yield from ()

    def close(self) -> None:
        pass


class _Stopping(StatefulProcessor):
    """A question's answer once a complete poll satisfies a rule, or when its deadline passes.

    A question keeps its three highest values, its totals and its leader until its deadline;
    after the decision later polls are ignored.
    """

    OUT = "question string, tick bigint, reason string, answer bigint"

    def __init__(self, full_count: int, enough_math: int):
        self.full_count, self.enough_math = full_count, enough_math

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        scopes = ", ".join(f"frequency_{s} array<bigint>, value_{s} array<string>" for s in ("all", "math"))
        self.held = HeldTable(
            handle, "questions", f"question string, until_ms bigint, votes bigint, math_votes bigint, decided boolean, last bigint, weight bigint, leader string, {scopes}"
        )

    def _row(self, question: str, tick: int, reason: str, best: tuple[int, int]) -> tuple:
        return question, tick, reason, best[1] % MODULUS if best[0] >= 0 else DEFAULT_ANSWER

    def _keep(self, questions: dict[str, tuple]) -> None:
        self.held.put_rows(questions.values())
        if questions:
            self.handle.registerTimer(min(q[1] for q in questions.values()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = {q[0]: q for q in self.held.rows()}, []
        for question, polls in _polled(rows, ["tick", "last", "until_ms", "value", "n", "n_math", "all_now", "math_now"]):
            known, found = held.get(question), None
            if known and known[4]:
                continue
            _, until, votes, math_votes, _, last, weight, leader, *tops = known or (question, None, 0, 0, False, None, -1, "0", [], [], [], [])
            top = {"all": list(zip(tops[0], map(int, tops[1]))), "math": list(zip(tops[2], map(int, tops[3])))}
            best = (weight, int(leader))
            for tick, part in groupby(polls, itemgetter(0)):
                for _, latest, until, value, n, n_math, all_now, math_now in part:
                    last = latest if last is None else last
                    votes, math_votes = votes + n, math_votes + n_math
                    if value is None:
                        continue
                    value = int(value)
                    top["all"] = _raised(top["all"], value, _frequency(value, all_now))
                    top["math"] = _raised(top["math"], value, _frequency(value, math_now)) if math_now else top["math"]
                    best = max(best, (_weight(value, all_now), value))
                agree = {s: agreement(*([f for f, _ in t] + [0, 0, 0])[:3]) for s, t in top.items()}
                reason = (
                    "math_agrees" if agree["math"] else "all_agree" if agree["all"] else "all_in" if votes == self.full_count
                    else "enough_math" if math_votes >= self.enough_math else "deadline" if tick >= last else None
                )
                if reason:
                    found = True
                    out.append(self._row(question, tick, reason, best))
                    break
            listed = [x for t in top.values() for x in ([f for f, _ in t], [str(v) for _, v in t])]
            held[question] = (question, until, votes, math_votes, bool(found), last, best[0], str(best[1]), *listed)
        self._keep(held)
        if out:
            yield pd.DataFrame(out, columns=["question", "tick", "reason", "answer"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.held.rows()
        out = [self._row(q[0], q[5], "deadline", (q[6], int(q[7]))) for q in held if q[1] <= now and not q[4]]
        self._keep({q[0]: q for q in held if q[1] > now})
        if out:
            yield pd.DataFrame(out, columns=["question", "tick", "reason", "answer"])

    def close(self) -> None:
        pass


def _chained(rows: DataFrame, first: StatefulProcessor, last: StatefulProcessor, timed: bool) -> DataFrame:
    """The two operators of a flow behind one another, in one query."""
    mode = "EventTime" if timed else "None"
    time = {"eventTimeColumnName": "ts"} if timed else {}
    dealt = rows.withColumn("bucket", bucket_of("question", F.pmod(F.xxhash64("value"), F.lit(PARTS))))
    counts = dealt.groupBy("bucket").transformWithStateInPandas(first, _COUNTS, "Append", mode, **time)
    found = counts.withColumn("bucket", bucket_of("question")).groupBy("bucket").transformWithStateInPandas(last, last.OUT, "Append", mode)
    return found.select(key_of("question", "bigint").alias("question_id"), *[c for c in found.columns if c != "question"])


def _merged(rows: DataFrame, delay_ms: int | None) -> DataFrame:
    merged = rows.mapInPandas(combined, _ROWS)
    # One more millisecond, as rows of the watermark's own time count as late.
    if delay_ms is None:
        return merged
    # Ticks of the clock (poll -1) have moved the watermark and go. The condition names the event
    # time, as another would be tested before the watermark sees the row.
    return merged.withWatermark("ts", f"{delay_ms + 1} milliseconds").where("tick >= 0 OR ts IS NULL")


# ---- Live votes ------------------------------------------------------------------------


def live_votes(answers: DataFrame, ts: str = "ts", until: str | None = None, delay: str | None = None) -> DataFrame:
    """A row per question whenever its vote has changed, as answers come in.

    Rows carry the votes so far, the three highest frequencies, the stop flag and the leading
    answer. With the column ``until``, the time a question closes, only answers up to it are
    counted and its states end there; that takes a ``delay`` for answers out of order (see
    ``split_late``).
    """
    if (until is None) != (delay is None):
        raise ValueError("a closing time and a delay go together")
    closes = (F.col(until) if until else F.lit(None)).cast("timestamp")
    valid = answers.select(
        never_missing("question_id").alias("question"), never_missing(answer_value("answer")).alias("value"), F.lit(0).cast("bigint").alias("tick"), F.lit(0).cast("bigint").alias("last"),
        F.coalesce(F.unix_millis(closes) + 2, F.lit(NEVER)).alias("until_ms"), F.lit(1).cast("bigint").alias("n"),
        F.coalesce(F.col("method") == "math", F.lit(False)).cast("bigint").alias("n_math"), F.col(ts).alias("ts"), (F.unix_millis(ts) + 1).alias("ts_ms"),
        *([closes.alias("closes")] if until else []),
    ).where("value <> ''")
    if until:
        valid = valid.where("ts <= closes").drop("closes")
    live = _chained(_merged(valid, milliseconds(delay) if delay else None), _Counting(False, until is not None), _Voting(until is not None), until is not None)
    return live.select(
        "question_id", "votes", "highest", "second", "third",
        agreement(F.col("highest"), F.col("second"), F.col("third")).alias("stop"),
        floor_mod("leader").alias("answer"),
    )


def latest_votes(history: DataFrame) -> DataFrame:
    """The last row of each question out of what ``live_votes`` has written."""
    others = [c for c in history.columns if c != "question_id"]
    return history.groupBy("question_id").agg(F.max(F.struct(*others)).alias("row")).select("question_id", "row.*")


# ---- Early stop ----------------------------------------------------------------------


def _after(started: str, tick: str, poll: int) -> Column:
    return F.col(started) + F.make_dt_interval(secs=(F.col(tick) * poll).cast("decimal(18,6)"))


def early_stop(
    answers: DataFrame, questions: DataFrame, delay: str, poll: int = POLL_SECONDS, full_count: int = FULL_COUNT, enough_math: int = ENOUGH_MATH,
) -> DataFrame:
    """A question's answer once a complete poll satisfies a rule, or when its deadline passes.

    ``answers``: question_id, method, answer, arrival (seconds since the question started),
    started (timestamp); a row without an arrival is a tick of the clock at ``started``, which
    moves time on when no answers come. ``questions``: question_id and deadline, a table. A poll
    is complete ``delay`` after its end; later answers belong to ``split_late``.
    """
    asked = questions.select("question_id", last_poll(F.col("deadline"), poll).alias("last"), F.lit(True).alias("asked"))
    timed = join_on(
        answers.select(
            "question_id", answer_value("answer").alias("value"), poll_tick(F.col("arrival"), poll).alias("tick"), F.col("arrival").isNull().alias("clock"),
            F.coalesce((F.col("method") == "math").cast("bigint"), F.lit(0)).alias("n_math"), "started",
        ), asked, ["question_id"], "left",
    ).where("clock OR (asked AND tick <= last)")
    ts = F.when(F.col("clock"), F.col("started")).otherwise(_after("started", "tick", poll))
    until = F.when(F.col("clock"), F.col("started")).otherwise(_after("started", "last", poll))
    rows = timed.select(
        never_missing("question_id").alias("question"), never_missing("value").alias("value"), F.when(F.col("clock"), -1).otherwise(F.col("tick")).cast("bigint").alias("tick"), F.coalesce("last", F.lit(0)).cast("bigint").alias("last"),
        (F.unix_millis(until) + 2).alias("until_ms"), F.when(F.col("clock"), 0).otherwise(1).cast("bigint").alias("n"), "n_math", ts.alias("ts"), (F.unix_millis(ts) + 1).alias("ts_ms"),
    ).where("ts IS NOT NULL")
    # A poll ends up to ``poll`` seconds behind its answers.
    return _chained(_merged(rows, milliseconds(delay) + poll * 1000), _Counting(True, True), _Stopping(full_count, enough_math), True)


def with_unanswered(questions: DataFrame, stops: DataFrame, poll: int = POLL_SECONDS) -> DataFrame:
    """What ``early_stop`` wrote, and the default at its deadline for a question without any answer."""
    asked = questions.select("question_id", last_poll(F.col("deadline"), poll).alias("last"))
    return join_on(asked, stops, ["question_id"], "left").select(
        "question_id", F.coalesce("tick", "last").alias("tick"), F.coalesce("reason", F.lit("deadline")).alias("reason"),
        F.coalesce("answer", F.lit(DEFAULT_ANSWER).cast("bigint")).alias("answer"),
    )
