"""Hard negatives for anchors, by slots of scores.

Vectors are made of whole numbers, a score is an integer inner product. An anchor's positives are
its best other rows of its label; each sets a window of scores, from a low to a high share of its
own, and the best rows of other labels in that window are its negatives. The windows of one
anchor overlap, so rows are not sought window by window: the upper limits of the positives split
the scores below the highest limit into disjoint slots, every row falls into one slot, and each
slot keeps its k best rows, in each task first and then over all tasks. From the lowest slot up,
a slot's rows in front of those kept below it are the k best rows under its upper limit; a window
takes from these what reaches its lower limit.

Anchors are a stated query set: blocks of bounded size meet all rows in groups of bounded size,
each pair of which is a task of its own. Rows are dealt by a digest, so a label or a vector that
a third of all rows have is shared out like any other. A task keeps no more than k rows of each
slot of its anchors at a time.

Defined results: rows without an id or a label, and vectors null, or with a null or non-finite
component, take no part; missing components of shorter vectors are 0; rows of one id, vector and
label are one row; an id with several of these asks once for each, and rows of the anchor's own
id are never its results. A positive of a negative score has no window. Ties go to the smaller
id; a positive that has no negative has no row. Scores beyond 64 bits are an error. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.block_topk import Products, matrix, usable, whole_numbers
from tallywork.llm.common import Batches
from tallywork.operators.stages import written

GROUP_CANDIDATES, GROUP_ANCHORS = 16384, 4096
#: Rows scored at a time in a task, times anchors.
SCORES_AT_ONCE = 1 << 22


class Kept:
    """The k best rows of each list, of scores that come in pieces."""

    def __init__(self, lists: int, k: int, kind: type):
        self.k, self.lists = k, np.zeros(0, np.int64)
        self.scores, self.ids = np.zeros(0, kind), np.zeros(0, np.int64)
        lowest = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min, object: -(1 << 80)}[kind]
        #: The k-th score of each list that has k.
        self.floor = np.full(lists, lowest, kind)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        lists, scores, ids = np.concatenate((self.lists, lists)), np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        counts = np.bincount(lists, minlength=len(self.floor))
        rank = np.arange(len(lists)) - np.repeat(np.cumsum(counts) - counts, counts)
        top = rank < self.k
        self.lists, self.scores, self.ids = lists[top], scores[top], ids[top]
        last = rank[top] == self.k - 1
        self.floor[self.lists[last]] = self.scores[last]


def blocks_of(anchors: int, candidates: int) -> Iterator[slice]:
    step = max(1, SCORES_AT_ONCE // max(1, anchors))
    return (slice(at, at + step) for at in range(0, candidates, step))


def best_of_label(asked: np.ndarray, asked_id: np.ndarray, asked_label: np.ndarray, there: np.ndarray, ids: np.ndarray, label: np.ndarray, k: int) -> Kept:
    """Of each anchor, the k best other rows of its label."""
    exact = Products(asked, there)
    asked, there = exact.of(asked), exact.of(there)
    kept = Kept(len(asked), k, exact.kind)
    for part in blocks_of(len(asked), len(there)):
        scores = asked @ there[part].T
        fits = (asked_label[:, None] == label[part]) & (asked_id[:, None] != ids[part]) & (scores >= kept.floor[:, None])
        a, c = np.nonzero(fits.astype(bool))
        kept.add(a, scores[a, c], ids[part][c])
    return kept


def best_of_slots(
    asked: np.ndarray, asked_id: np.ndarray, asked_label: np.ndarray, limits: np.ndarray, low: np.ndarray,
    there: np.ndarray, ids: np.ndarray, label: np.ndarray, k: int,
) -> Kept:
    """The k best rows of other labels in each slot; list number: anchor * slots + slot.

    ``limits`` has each anchor's upper limits, the highest first; a score is in the last slot
    whose limit it does not exceed. Scores below ``low`` are in no window.
    """
    exact = Products(asked, there)
    asked, there = exact.of(asked), exact.of(there)
    slots = limits.shape[1]
    kept = Kept(len(asked) * slots, k, exact.kind)
    first = np.arange(len(asked))[:, None] * slots
    for part in blocks_of(len(asked) * slots, len(there)):
        scores = asked @ there[part].T
        fits = (asked_label[:, None] != label[part]) & (asked_id[:, None] != ids[part]) & (scores >= low[:, None]) & (scores <= limits[:, :1])
        a, c = np.nonzero(fits.astype(bool))
        found = scores[a, c]
        lists = first[a, 0] + (found[:, None] <= limits[a]).sum(axis=1) - 1
        reach = (found >= kept.floor[lists]).astype(bool)
        kept.add(lists[reach], found[reach], ids[part][c[reach]])
    return kept


def windows(positives: list[tuple[int, int]], kept: list[tuple[int, int, int]], k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(positive, its score, rank, negative, its score) from an anchor's positives (score, id) and kept rows (slot, score, id)."""
    limits = limits_of([s for s, _ in positives], high)
    rows = sorted(kept, key=lambda r: (r[0], -r[1], r[2]))
    below: list[tuple[int, int]] = []
    under: dict[int, list[tuple[int, int]]] = {}
    # The rows of a slot are above all of the slots below it.
    for slot in range(len(limits) - 1, -1, -1):
        below = ([(s, i) for at, s, i in rows if at == slot] + below)[:k]
        under[limits[slot]] = below
    for score, positive in positives:
        if score >= 0:
            chosen = [(s, i) for s, i in under[score * high // 100] if 100 * s >= low * score]
            yield from ((positive, score, rank, i, s) for rank, (s, i) in enumerate(chosen, 1))


def limits_of(scores: list[int], high: int) -> list[int]:
    """The different upper limits of the windows of positives with these scores, the highest first."""
    return sorted({s * high // 100 for s in scores if s >= 0}, reverse=True)


def _vectors(held: pa.Table, width: int) -> np.ndarray:
    return matrix(held.column("v").combine_chunks(), width)


def _width(*tables: pa.Table) -> int:
    return max(1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables))


def mined(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
    key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    group_candidates: int = GROUP_CANDIDATES, group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """The ``k`` best rows of other labels with ``low`` to ``high`` percent of each positive's score.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    chosen = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), is_anchor.alias("asks"), label.cast("long").alias("label"),
    )
    there = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = there.select("id", "label", whole_numbers(F.col("v"), scale).alias("v"), "asks")
    asking = rows.where("asks").select("id", "label", "v").distinct().withColumn("anchor", F.xxhash64("id", "label", "v"))
    candidates = rows.select("id", "label", "v").distinct()

    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    parts, blocks = max(1, -(-counts["n"] // group_candidates)), max(1, -(-counts["q"] // group_anchors))
    right = candidates.withColumns({
        "part": F.pmod(F.xxhash64("id", "label", "v"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
    }).withColumn("block", F.col("block").cast("long"))

    def meeting(anchors: DataFrame, task, schema: str) -> DataFrame:
        """``task`` on each block of anchors with each part of the rows."""
        left = anchors.withColumns({"block": F.pmod("anchor", F.lit(blocks)), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
        left = left.withColumn("part", F.col("part").cast("long"))
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(task, schema)

    def first_positives(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "anchor": [], "score": [], "id": []}
        if asked.num_rows and held.num_rows:
            width, ids = _width(asked, held), asked.column("id").to_numpy()
            kept = best_of_label(
                _vectors(asked, width), ids, asked.column("label").to_numpy(), _vectors(held, width), held.column("id").to_numpy(), held.column("label").to_numpy(), positives,
            )
            digests = asked.column("anchor").to_numpy()
            out = {"anchor_id": ids[kept.lists], "anchor": digests[kept.lists], "score": [int(s) for s in kept.scores], "id": kept.ids}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = meeting(asking, first_positives, "anchor_id long, anchor long, score long, id long")
    best = Window.partitionBy("anchor_id", "anchor").orderBy(F.desc("score"), F.asc("id"))
    # At most ``positives`` rows of each anchor are gathered.
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    chosen_positives = ranked.groupBy("anchor_id", "anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "score"))).alias("positives"))
    known = written(asking.join(chosen_positives.withColumnRenamed("anchor_id", "id"), ["id", "anchor"]), "positives")

    def best_rows(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "anchor": [], "slot": [], "score": [], "id": []}
        if asked.num_rows and held.num_rows:
            limits = [limits_of([p["score"] for p in ps], high) for ps in asked.column("positives").to_pylist()]
            lowest = [-(-low * min((p["score"] for p in ps if p["score"] >= 0), default=0) // 100) for ps in asked.column("positives").to_pylist()]
            live = np.array([bool(x) for x in limits])
            slots = max(map(len, limits), default=0)
            if slots:
                asked = asked.filter(pa.array(live))
                # Unused slots lie below every score that is kept.
                bounds = np.array([[*x, *[l - 1] * (slots - len(x))] for x, l in zip(limits, lowest) if x], np.int64)
                floor = np.array([l for x, l in zip(limits, lowest) if x], np.int64)
                width, ids = _width(asked, held), asked.column("id").to_numpy()
                kept = best_of_slots(
                    _vectors(asked, width), ids, asked.column("label").to_numpy(), bounds, floor,
                    _vectors(held, width), held.column("id").to_numpy(), held.column("label").to_numpy(), k,
                )
                at, digests = kept.lists // slots, asked.column("anchor").to_numpy()
                out = {"anchor_id": ids[at], "anchor": digests[at], "slot": kept.lists % slots, "score": [int(s) for s in kept.scores], "id": kept.ids}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    slotted = meeting(known, best_rows, "anchor_id long, anchor long, slot long, score long, id long")
    of_slot = Window.partitionBy("anchor_id", "anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
    kept = slotted.withColumn("rank", F.row_number().over(of_slot)).where(F.col("rank") <= k)
    # At most k rows for each slot of an anchor, which has no more slots than positives.
    gathered = kept.groupBy("anchor_id", "anchor").agg(F.collect_list(F.struct("slot", "score", "id")).alias("kept"))
    both = gathered.join(known.select(F.col("id").alias("anchor_id"), "anchor", "positives"), ["anchor_id", "anchor"]).select("anchor_id", "positives", "kept")

    def answer(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                near = [(p["score"], p["id"]) for p in row["positives"]]
                out += [(row["anchor_id"], *w) for w in windows(near, [(s["slot"], s["score"], s["id"]) for s in row["kept"]], k, low, high)]
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ["anchor_id", "positive_id", "positive_score", "rank", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    answered = both.mapInArrow(answer, "anchor_id long, positive_id long, positive_score long, rank int, negative_id long, negative_score long")
    return answered.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
