"""Generations assembled from a stream of chunks, and throttled checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywork.functions.text import FENCE, FILLED_BOX, PYTHON_FENCE, answer_outside_sections, last_boxed
from tallywork.streaming.runs import HeldTable, bucket_of, key_of, milliseconds, never_missing

KEY = "key__"
REQUEST = {"generation_id": "bigint", "request_counter": "bigint", "method": "string"}
_BOX = re.compile(FILLED_BOX)
#: Buckets of requests; more than of the other streams, as open texts are kept in them.
TEXT_BUCKETS = 256
#: Chunks that are put together at a time.
CHUNKS_AT_ONCE = 1 << 18


def ended(math: bool, text: str, known: int, scan: int) -> tuple[int, int]:
    """Where the first filled box or block ends, or -1, and where a next search begins.

    Nothing ends within the first ``known`` characters. An end is the same in any longer text.
    """
    if math:
        # A box does not span lines: look from the start of the line that the new text began in.
        box = _BOX.search(text, text.rfind("\n", 0, known) + 1) if "}" in text[known:] else None
        return (box.end() if box else -1), scan
    while (opened := text.find(PYTHON_FENCE, scan)) >= 0:
        # An open block is searched from its fence again.
        scan, inside = opened, opened + len(PYTHON_FENCE)
        if (closed := text.find(FENCE, inside)) < 0:
            return -1, scan
        scan = closed + len(FENCE)
        if text[inside:closed].strip():
            return scan, scan
    # A fence may be coming in.
    return -1, max(scan, len(text) - len(PYTHON_FENCE))


class _Assembling(StatefulProcessor):
    """Requests put together as their chunks come.

    A bucket of requests holds a table of these, with the text so far, and one of the chunks behind a
    gap, and a timer for the first time at which a request has been idle. A request that is written
    stays as a mark without a text.
    """

    OUT = f"{KEY} string, text string, chunks bigint, reason string, missing bigint"
    #: No chunk follows in a request that is written.
    NONE = 1 << 62

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = HeldTable(handle, "requests", f"{KEY} string, text string, following bigint, scan bigint, done boolean, until_ms bigint")
        self.behind = HeldTable(handle, "behind", f"{KEY} string, chunk_idx bigint, chunk string, is_last boolean")

    def _keep(self, requests: dict[str, tuple]) -> None:
        self.requests.put_rows((key, *known) for key, known in requests.items())
        if requests:
            self.handle.registerTimer(min(known[-1] for known in requests.values()))

    def _written(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[KEY, "text", "chunks", "reason", "missing"]).astype({"missing": "Int64"})

    def _advanced(self, requests: dict[str, tuple], behind: pd.DataFrame, fresh: pd.DataFrame, now: int) -> tuple[pd.DataFrame, list[tuple]]:
        """Add ``fresh`` chunks to ``requests``; those still behind a gap, and the finished requests."""
        every = pd.concat([part[self.behind.columns] for part in (behind, fresh) if len(part)], ignore_index=True)
        codes, keys = pd.factorize(every[KEY])
        latest = pd.Series(fresh["ms"].to_numpy()).groupby(codes[len(behind) :]).max()
        for key, ms in zip(keys[latest.index], latest.tolist()):
            text, following, scan, done, until = requests.get(key, ("", 0, 0, False, 0))
            requests[key] = (text, following, scan, done, max(until, ms + self.idle_ms, now + self.idle_ms))
        nexts = np.array([self.NONE if requests[key][3] else requests[key][1] for key in keys], np.int64)

        places = every["chunk_idx"].to_numpy()
        order = np.lexsort((places, codes))
        codes, places = codes[order], places[order]
        # Of chunks that came twice the last one counts, unless the first is in the text.
        newest = np.append((codes[1:] != codes[:-1]) | (places[1:] != places[:-1]), True)
        wanted = newest & (places >= nexts[codes])
        order, codes, places = order[wanted], codes[wanted], places[wanted]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        stops = np.append(starts[1:], len(codes))
        joins = places - nexts[codes] == np.arange(len(codes)) - np.repeat(starts, stops - starts)
        counts = np.add.reduceat(joins.astype(np.int64), starts) if len(starts) else starts
        chunks, lasts = every["chunk"].to_numpy()[order].tolist(), every["is_last"].to_numpy(bool)[order]
        stays, finished = ~joins, []
        for key, start, stop, count in zip(keys[codes[starts]], starts.tolist(), stops.tolist(), counts.tolist()):
            if not count:
                continue
            ends = np.flatnonzero(lasts[start : start + count])
            is_last, count = len(ends) > 0, int(ends[0]) + 1 if len(ends) else count
            text, following, scan, _, until = requests[key]
            pieces, known = chunks[start : start + count], len(text)
            text, math = text + "".join(pieces), key.split("\n", 2)[2] == "=math"
            end, scan = ended(math, text, known, scan)
            if end < 0 and not is_last:
                requests[key] = (text, following + count, scan, False, until)
                continue
            reason = "stop_token" if end < 0 else "boxed" if math else "code_block"
            if end >= 0:
                lengths = known + np.cumsum([len(p) for p in pieces])
                count = int(np.searchsorted(lengths, end)) + 1
                text = text[: lengths[count - 1]]
            finished.append((key, text, following + count, reason, None))
            requests[key] = ("", following + count, 0, True, until)
            stays[start:stop] = False
        return every.iloc[order[stays]], finished

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        requests, behind = {key: known for key, *known in self.requests.rows()}, self.behind.get()
        now, held, size = timerValues.getCurrentWatermarkInMs(), [], 0
        for batch in (*rows, None):
            if batch is not None:
                held.append(batch)
                size += len(batch)
            if held and (batch is None or size >= CHUNKS_AT_ONCE):
                behind, finished = self._advanced(requests, behind, pd.concat(held, ignore_index=True), now)
                held, size = [], 0
                if finished:
                    yield self._written(finished)
        self._keep(requests)
        self.behind.put(behind)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, behind = timerValues.getCurrentWatermarkInMs(), self.behind.get()
        requests = {key: known for key, *known in self.requests.rows()}
        ended = {key for key, known in requests.items() if known[-1] <= now}
        gone = behind[KEY].isin(ended)
        rest = {key: of["chunk"].tolist() for key, of in behind[gone].sort_values([KEY, "chunk_idx"]).groupby(KEY, sort=False)}
        written = []
        for key in ended:
            text, following, _, done, _ = requests.pop(key)
            if not done:
                more = rest.get(key, [])
                written.append((key, text + "".join(more), following + len(more), "expired", following if more else None))
                requests[key] = ("", following, 0, True, now + self.idle_ms)
        self._keep(requests)
        self.behind.put(behind[~gone])
        if written:
            yield self._written(written)

    def close(self) -> None:
        pass


def assemble_generations(chunks: DataFrame, delay: str, idle: str, ts: str = "ts", buckets: int = TEXT_BUCKETS) -> DataFrame:
    """One row per finished request, written as soon as it is finished.

    ``chunks``: generation_id, request_counter, method, chunk_idx, chunk, is_last and an
    event time. Chunks may come in any order within the ``delay``. A code request ends with its first filled, closed code block, a
    math request with its first filled box, both at the latest with the last chunk. A
    request that stays idle is written with the reason 'expired': all chunks there are, in
    order, and the first ``missing`` one if chunks behind a gap are among them. Once a request
    is written its text is dropped; a mark stays until it is idle, to ignore later chunks.
    Chunks later than the ``delay`` belong to ``split_late``. A missing text is empty; a chunk without
    a number has no place. A stream keeps its number of ``buckets`` for good; a task holds
    the open texts of one.
    """
    # A millisecond more, as rows of the watermark's own time count as late.
    timed = chunks.withWatermark(ts, f"{milliseconds(delay) + 1} milliseconds").select(
        F.concat_ws("\n", *(never_missing(c) for c in REQUEST)).alias(KEY), F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.coalesce("chunk", F.lit("")).alias("chunk"), F.coalesce("is_last", F.lit(False)).alias("is_last"),
        F.coalesce(F.unix_millis(ts), F.lit(0)).alias("ms"), ts,
    ).where(F.col("chunk_idx").isNotNull())
    dealt = timed.withColumn("bucket", bucket_of(KEY, buckets=buckets))
    written = dealt.groupBy("bucket").transformWithStateInPandas(_Assembling(milliseconds(idle)), _Assembling.OUT, "Append", "EventTime")
    parts = F.split(KEY, "\n", len(REQUEST))
    request = [key_of(parts[i], kind).alias(c) for i, (c, kind) in enumerate(REQUEST.items())]
    finished = written.select(*request, "text", "chunks", "reason", "missing")
    answer = F.when(F.col("method") == "math", last_boxed("text")).otherwise(answer_outside_sections("text"))
    return finished.withColumn("answer", answer)


class _InOrder(StatefulProcessor):
    """Checks wait until the watermark has passed them and are judged in their order, each key for itself.

    A bucket of keys holds a table of what waits and one of each key's last kept check, and a timer for
    the first time at which something is due: a check, or the end of a key that has been idle.
    """

    def __init__(self, time: str, kind: str, gap: float, idle_ms: int):
        self.time, self.kind, self.gap, self.idle_ms = time, kind, gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = HeldTable(handle, "waiting", f"{KEY} string, ms bigint, time {self.kind}")
        self.kept = HeldTable(handle, "kept", f"{KEY} string, ms bigint, time {self.kind}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([*rows], ignore_index=True).rename(columns={self.time: "time"})[self.waiting.columns]
        held = self.waiting.get()
        self.waiting.put((pd.concat([held, fresh], ignore_index=True) if len(held) else fresh).drop_duplicates())
        self.handle.registerTimer(int(fresh["ms"].min()))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self.waiting.get()
        passed = held["ms"] <= now
        due, later = held[passed].sort_values([KEY, "time"]), held[~passed]
        kept, released = {k: (ms, last) for k, ms, last in self.kept.rows()}, []
        for owner, ms, t in zip(due[KEY].tolist(), due["ms"].tolist(), due["time"].tolist()):
            newest, last = kept.get(owner, (ms, None))
            if last is None or t >= last + self.gap:
                released.append((owner, t))
                last = t
            kept[owner] = (max(newest, ms), last)
        busy = set(later[KEY])
        kept = {k: v for k, v in kept.items() if k in busy or v[0] + self.idle_ms > now}
        if passed.any():
            self.waiting.put(later)
        self.kept.put_rows([(k, *v) for k, v in kept.items()])
        ends = [int(later["ms"].min())] if len(later) else []
        ends += [ms + self.idle_ms for k, (ms, _) in kept.items() if k not in busy]
        if ends:
            self.handle.registerTimer(min(ends))
        if released:
            yield pd.DataFrame(released, columns=[KEY, self.time])

    def close(self) -> None:
        pass


def throttle(
    checks: DataFrame, key: str, time: str, delay: str, gap: float = 5, ts: str = "ts", idle: str = "1 hour"
) -> DataFrame:
    """Keep a check only if it comes at least ``gap`` after the last kept one of its key.

    ``time`` is the number the gap is measured on, ``ts`` the event time, which goes up with it.
    Checks may come in any order within the ``delay``: they wait for the watermark, and the
    result is that of the batch operator. Later ones belong to ``split_late``. A check without a
    time is none, but its event time moves the watermark on, as a tick of the clock. A key's
    state may end after ``idle``, which is no shorter than the gap. Equal times of a key are
    merged before they are shuffled.
    """
    names = dict(checks.dtypes)

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates([KEY, time])

    # A millisecond more on either side, as rows of the watermark's own time count as late.
    timed = checks.select(never_missing(key).alias(KEY), time, ts, (F.unix_millis(ts) + 1).alias("ms")).where(F.col(ts).isNotNull())
    merged = timed.mapInPandas(distinct, f"{KEY} string, {time} {names[time]}, {ts} timestamp, ms bigint")
    # The condition names the event time, as another would be tested before the watermark sees the row.
    marked = merged.withWatermark(ts, f"{milliseconds(delay) + 2} milliseconds").where(F.col(time).isNotNull() | F.col(ts).isNull())
    judge = _InOrder(time, names[time], gap, milliseconds(idle))
    dealt = marked.withColumn("bucket", bucket_of(KEY))
    kept = dealt.groupBy("bucket").transformWithStateInPandas(judge, f"{KEY} string, {time} {names[time]}", "Append", "EventTime")
    return kept.select(key_of(KEY, names[key]).alias(key), time)
