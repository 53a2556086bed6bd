"""Checks kept at a minimum distance, each depending on the one kept before.

A key's times are cut into slices. A slice's outcome depends on the time kept last before
it only through the first time it keeps, its entry, and only the times of its first ``gap``
can be entries. So each slice lists its entries with the exit (last kept time) that each
leads to. Lists of neighbouring slices are put together into one of the same kind, a few at a
time, until a key has few; a walk picks the entries there, and those of the parts below on
the way back. At last each slice keeps what follows from its entry. No task sees more than a
slice of a key's times, or the lists of a few neighbours.

A key with more distinct times in some slice than a list should hold goes another way, with a
row per time only: each time's next allowed one is found by a search over ranges of all times,
and these links are doubled round by round while the times reached from the key's first one
are marked. Both ways keep the same times.

A check without a time is none; one without a key belongs to the missing key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.operators.joins import join_on
from tallywork.operators.stages import written

GAP = 5
GAPS_PER_SLICE = 200
NEIGHBOURS = 64
#: Distinct times of a slice that are held as a list.
MOST_LISTED = 1 << 16


def _follow(parts: list, gap: float, last: float | None = None, entry: float | None = None) -> tuple[list, float | None]:
    """The entry of each part entered, and the last kept time, behind ``last`` or from ``entry`` on."""
    entered = []
    for part in parts:
        entries = part["entries"]
        if entry is not None:
            at = int(np.searchsorted(entries, entry))
            if at == len(entries) or entries[at] != entry:
                continue
            entry = None
        else:
            at = 0 if last is None else int(np.searchsorted(entries, last + gap))
        if at < len(entries):
            last = part["exits"][at]
            entered.append((part["part"], entries[at]))
    return entered, last


def _entered(listed: DataFrame, key: str, gap: float, kind: str, neighbours: int) -> DataFrame:
    """key, part, entry of each part that is entered, from key, part, entries, exits."""
    listed = written(listed, "throttle")
    types = dict(listed.dtypes)
    gathered = F.sort_array(F.collect_list(F.struct("part", "entries", "exits"))).alias("parts")
    out = f"{key} {types[key]}, part bigint, entry {kind}"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for owner, parts, entry in zip(batch[key], batch["parts"], batch["entry"]):
                entered, _ = _follow(parts, gap, entry=None if pd.isna(entry) else entry)
                rows.extend((owner, part, at) for part, at in entered)
            yield pd.DataFrame(rows, columns=[key, "part", "entry"])

    most = listed.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if most <= neighbours:
        return listed.groupBy(key).agg(gathered).withColumn("entry", F.lit(None).cast(kind)).mapInPandas(walk, out)
    groups = written(listed.groupBy(key, F.floor(F.col("part") / neighbours).alias("group")).agg(gathered), "throttle")

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries, exits = [], []
            for parts in batch["parts"]:
                # A first part that is too close to what came before leaves the next one's first time.
                possible = [*parts[0]["entries"], *(p["entries"][0] for p in parts[1:2])]
                entries.append(possible)
                exits.append([_follow(parts, gap, entry=e)[1] for e in possible])
            yield pd.DataFrame({key: batch[key], "part": batch["group"], "entries": entries, "exits": exits})

    together = groups.mapInPandas(put_together, f"{key} {types[key]}, part bigint, entries array<{kind}>, exits array<{kind}>")
    above = _entered(together, key, gap, kind, neighbours).select(F.col(key).alias("__key"), F.col("part").alias("__part"), "entry")
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("group") == F.col("__part"))
    return groups.join(above, same).select(key, "parts", "entry").mapInPandas(walk, out)


def next_allowed(times: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """Per distinct (key, time): the first time of the key that is at least ``gap`` later, as ``to`` (null if none).

    Times, and for each the least time allowed behind it, are dealt together by range and read
    from the end: an allowed time is answered by the last time read. What no later row of its
    range answers is the first time of the key in a range behind, one row for each key and range.
    """
    kind = dict(times.dtypes)[time]
    asked = times.select(key, (F.col(time) + gap).cast(kind).alias("__at"), F.col(time).alias("__of"))
    every = times.select(key, F.col(time).alias("__at"), F.lit(None).cast(kind).alias("__of")).unionByName(asked)
    # Of equal values the time comes before the question in this order, so that it answers it.
    order = [F.col(key).desc_nulls_last(), F.col("__at").desc(), F.col("__of").asc_nulls_first()]
    ranged = every.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_time = (), None
        for batch in batches:
            keys, at, of = (batch.column(i) for i in range(3))
            if not len(keys):
                continue
            places = np.arange(len(keys))
            changed = pc.if_else(pc.is_null(keys[1:]), pc.is_valid(keys[:-1]), pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], changed.to_numpy(zero_copy_only=False))), places, 0))
            # The last time read so far, if it is one of the same key.
            read = np.maximum.accumulate(np.where(pc.is_null(of).to_numpy(zero_copy_only=False), places, -1))
            to = at.take(pa.array(read, mask=read < first))
            if last_time is not None and (keys[0].as_py(),) == last_key:
                to = pc.if_else(pa.array((read < first) & (first == 0)), pa.scalar(last_time, at.type), to)
            last_key, last_time = (keys[-1].as_py(),), to[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, to], [*batch.schema.names, "to"])

    types = dict(every.dtypes)
    found = ranged.mapInArrow(answer, f"{key} {types[key]}, __at {kind}, __of {kind}, __part int, to {kind}")
    found = written(found, "throttle-links")
    # Parts go down with the keys and times: what answers a part's last questions lies in parts before it.
    firsts = found.groupBy(key, "__part").agg(F.min(F.when(F.col("__of").isNull(), F.col("__at"))).alias("__least"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(key, "__part", F.min("__least").over(earlier).alias("__carried"))
    asked = join_on(found.where(F.col("__of").isNotNull()), carried, [key, "__part"])
    return asked.select(key, F.col("__of").alias(time), F.coalesce("to", "__carried").alias("to"))


def linked_checks(times: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """The kept ones of distinct (key, time), by links to the next allowed time, doubled in each round."""
    links = written(next_allowed(times, key, time, gap), "throttle-links")
    reached = written(times.groupBy(key).agg(F.min(time).alias(time)), "throttle-kept")
    while True:
        more = join_on(reached, links, [key, time]).where("to IS NOT NULL").select(key, F.col("to").alias(time))
        more = written(more, "throttle-kept")
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        onward = links.select(key, F.col(time).alias("__over"), F.col("to").alias("__to"))
        doubled = join_on(links.where("to IS NOT NULL").withColumn("__over", F.col("to")), onward, [key, "__over"])
        links = written(doubled.select(key, time, F.col("__to").alias("to")), "throttle-links")


def throttled_checks(
    checks: DataFrame, key: str, time: str, gap: float = GAP, gaps_per_slice: int = GAPS_PER_SLICE, neighbours: int = NEIGHBOURS, most_listed: int = MOST_LISTED,
) -> DataFrame:
    """Keep a check only if it comes at least ``gap`` after the last kept one of its key."""
    types = dict(checks.dtypes)
    width = gap * gaps_per_slice
    times = checks.where(F.col(time).isNotNull()).select(key, time).distinct()
    part = F.floor(F.col(time) / width).alias("part")
    crowded = written(times.groupBy(key, part).count().where(F.col("count") > most_listed).select(key).distinct(), "crowded")
    # The slices are used twice.
    few = times if crowded.isEmpty() else join_on(times, crowded, [key], "left_anti")
    slices = written(few.groupBy(key, part).agg(F.sort_array(F.collect_list(time)).alias("times")), "slices")

    def doors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries, exits = [], []
            for part, times in zip(batch["part"], batch["times"]):
                following = np.searchsorted(times, times + gap)
                exit_at = np.arange(len(times))
                for i in range(len(times) - 1, -1, -1):
                    if following[i] < len(times):
                        exit_at[i] = exit_at[following[i]]
                # Entries: the times of the first gap, and the first time behind it.
                last = np.searchsorted(times, part * width + gap) + 1
                entries.append(times[:last])
                exits.append(times[exit_at[:last]])
            yield pd.DataFrame({key: batch[key], "part": batch["part"], "entries": entries, "exits": exits})

    kind = types[time]
    listed = slices.mapInPandas(doors, f"{key} {types[key]}, part bigint, entries array<{kind}>, exits array<{kind}>")
    entered = _entered(listed, key, gap, kind, neighbours).select(F.col(key).alias("__key"), F.col("part").alias("__part"), "entry")
    kept = F.aggregate(
        F.filter("times", lambda t: t > F.col("entry")),
        F.array("entry"),
        lambda chosen, t: F.when(t >= F.element_at(chosen, -1) + gap, F.array_append(chosen, t)).otherwise(chosen),
    )
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part"))
    listed_keys = slices.join(entered, same).select(key, F.explode(kept).alias(time))
    if crowded.isEmpty():
        return listed_keys
    return listed_keys.unionByName(linked_checks(join_on(times, crowded, [key], "left_semi"), key, time, gap))
