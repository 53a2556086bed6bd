"""Packing documents into token sequences of one size, as few as can be.

A document is its token ids and an end id. Longer ones than a sequence are cut into pieces of
full size, the first of which may be shorter. Only the lengths of pieces matter for packing, and
there are no more different lengths than a sequence has tokens; so the whole corpus is a
histogram of bounded size, whatever the number of documents, and packing works on counts.

``reduced`` fixes sets by the dominance rule of Martello and Toth: a set that holds a piece and
dominates all other sets that could hold it is in some best packing, so as many copies of it as
there are pieces are fixed at once, and the instance shrinks. ``best_fit`` puts what is left,
longest first, where the least room stays. Both give groups of equal sequences.

A piece's rank among those of its length is its position in the task that cut it, shifted by the
pieces of that length in earlier tasks; a group covers a range of ranks of each of its lengths.

Defined results: a null or empty text is one piece, the end id; each row is a document, also
rows of one key or without key; a string of a special token in a text becomes that token's id,
as the tokenizer reads it; an empty table gives no pieces. Texts are read whole. Ties are broken
by the order in which tasks read the rows. Other columns are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import Batches, slices
from tallywork.operators.stages import written

CAPACITY, END_ID = 2048, 0
TEXT_BYTES = 1 << 23
# Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# Token ids.


def _byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ids of byte strings and of special tokens in the text of a vocabulary file, if ids follow the order of merges.

    Then merging by least id is merging by first merge, which a quicker tokenizer does.
    """
    file = json.loads(vocabulary)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not file.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("ignore_merges"):
        return None
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    mark = _byte_of_mark()
    return {bytes(mark[c] for c in t): i for t, i in model["vocab"].items() if t not in special}, special


def encoder(vocabulary: str):
    """A function from texts to arrays of ids, as the vocabulary's tokenizer gives them without added tokens."""
    ranks = ranks_of(vocabulary)
    if ranks is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        return lambda texts: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks[0], special_tokens=ranks[1])
    return lambda texts: [np.array(encoding.encode(t, allowed_special="all", disallowed_special=()), np.uint32) for t in texts]


def pieces(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids: key, piece, start, length, ids (little-endian, 32 bits each), part, at.

    ``vocabulary`` is the path of a tokenizer's file; the driver reads it and tasks get its text.
    ``at`` is the piece's position among those of its length in the task ``part``. The pieces
    are a table, so that positions stay as they are if a task is run again.
    """
    with open(vocabulary, encoding="utf-8") as file:
        words = file.read()

    def run(batches: Batches) -> Batches:
        encode, seen = encoder(words), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, "text", TEXT_BYTES):
                out = {n: [] for n in ("row", "piece", "start", "length", "ids", "at")}
                for row, ids in enumerate(encode([t or "" for t in some.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
                    while start < len(ids):
                        for name, value in zip(out, (row, piece, start, stop - start, ids[start:stop].tobytes(), seen[stop - start])):
                            out[name].append(value)
                        seen[stop - start] += 1
                        start, stop, piece = stop, stop + capacity, piece + 1
                rows = pa.array(out.pop("row"), pa.int64())
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                columns = [some.column("key").take(rows), some.column("part").take(rows), *(pa.array(v, k) for v, k in zip(out.values(), kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "part", *out])

    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"))
    cut = chosen.mapInArrow(run, f"key {chosen.schema['key'].dataType.simpleString()}, part int, piece int, start long, length long, ids binary, at long")
    return written(cut.select(F.col("key").alias(key), "piece", "start", "length", "ids", "part", "at"), "pieces")


# Packing counts of lengths.


@dataclass
class Group:
    """``bins`` equal sequences with ``room`` left; parts are (length, first rank, pieces a sequence, offset)."""

    bins: int
    room: int
    parts: list[tuple[int, int, int, int]]

    def split(self, bins: int) -> tuple[Group, Group]:
        """The first ``bins`` sequences, and the others."""
        later = [(size, first + bins * times, times, offset) for size, first, times, offset in self.parts]
        return Group(bins, self.room, self.parts), Group(self.bins - bins, self.room, later)


class Stock:
    """Counts of pieces by length; ranks of a length are handed out in order."""

    def __init__(self, counts: dict[int, int]):
        self.left = {size: n for size, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.next = dict.fromkeys(self.left, 0)

    def take(self, size: int, n: int) -> int:
        """Remove ``n`` pieces; the first one's rank."""
        first = self.next[size]
        self.next[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            del self.sizes[bisect_left(self.sizes, size)]
        return first

    def smallest(self, n: int, without: list[int]) -> list[int]:
        """The ``n`` shortest pieces, or all, besides those of ``without``."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.left[size] - without.count(size))
            if len(out) >= n:
                break
        return out

    def largest(self, room: int, without: list[int]) -> int:
        """The longest piece that fits ``room`` besides those of ``without``, or 0."""
        at = bisect_right(self.sizes, room) - 1
        while at >= 0 and self.left[self.sizes[at]] <= without.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def pair_between(self, least: int, above: int, room: int, without: list[int]) -> bool:
        """Whether two pieces of over ``least`` each fit ``room`` and hold over ``above`` together."""
        fit = self.sizes[bisect_right(self.sizes, least) : bisect_right(self.sizes, room)]
        fit = [s for s in fit if self.left[s] > without.count(s)]
        for s in fit:
            r = fit[bisect_right(fit, room - s) - 1] if fit[0] <= room - s else 0
            if r == s and self.left[s] - without.count(s) < 2:
                r = fit[fit.index(s) - 1] if fit.index(s) else 0
            if r and r + s > above:
                return True
        return False


def dominating(stock: Stock, size: int, capacity: int) -> list[int] | None:
    """A set with a piece of ``size`` that dominates every other set that holds one, or None.

    Set F dominates set G if G's other pieces can be shared out among F's so that those given to
    one are together no longer than it: swapping them turns a packing with G into one with F.
    """
    room, mine = capacity - size, [size]
    short = stock.smallest(3, mine)
    most = 3 if len(short) == 3 and sum(short) <= room else 2 if len(short) > 1 and sum(short[:2]) <= room else 1 if short and short[0] <= room else 0
    if not most:
        return mine
    one = stock.largest(room, mine)
    # Any single piece that fits is no longer than ``one``; so is any set if ``one`` fills the room.
    if most == 1 or one == room:
        return [size, one]
    if most == 2:
        if not stock.pair_between(0, one, room, mine):
            return [size, one]
        two = stock.largest(room - one, [size, one])
        # A pair with a piece of up to ``two`` maps piece by piece; others must be no longer than ``one`` together.
        if two and not stock.pair_between(two, one, room, mine):
            return [size, one, two]
    return None


def reduced(stock: Stock, capacity: int) -> list[Group]:
    """Dominating sets, taken off the stock until no piece has one."""
    groups, before = [], -1
    while before != len(groups):
        before = len(groups)
        for size in reversed(list(stock.sizes)):
            while stock.left.get(size) and (chosen := dominating(stock, size, capacity)):
                # Fewer pieces leave fewer sets to dominate, so the set stands as long as there are pieces of its lengths.
                bins = min(stock.left[s] // chosen.count(s) for s in chosen)
                parts, offset = [], 0
                for s in dict.fromkeys(chosen):
                    times = chosen.count(s)
                    parts.append((s, stock.take(s, bins * times), times, offset))
                    offset += s * times
                groups.append(Group(bins, capacity - offset, parts))
    return groups


def best_fit(stock: Stock, capacity: int) -> list[Group]:
    """What is left in the stock, longest first, each piece where the least room stays."""
    open_: dict[int, list[Group]] = {}
    rooms: list[int] = []
    done = []

    def keep(group: Group) -> None:
        if not group.bins:
            return
        if not group.room:
            done.append(group)
            return
        if group.room not in open_:
            insort(rooms, group.room)
        open_.setdefault(group.room, []).append(group)

    def least_room(size: int) -> Group | None:
        at = bisect_left(rooms, size)
        if at == len(rooms):
            return None
        found = open_[rooms[at]].pop()
        if not open_[rooms[at]]:
            del open_[rooms[at]], rooms[at]
        return found

    for size in reversed(list(stock.sizes)):
        while n := stock.left.get(size, 0):
            group = least_room(size) or Group(n, capacity, [])
            # One after another, a sequence gets pieces of this length until the next does not fit.
            times = min(n, group.room // size)
            bins = min(group.bins, n // times)
            part, rest = group.split(bins)
            first = stock.take(size, bins * times)
            if group.parts:
                keep(rest)
            keep(Group(bins, group.room - times * size, [*part.parts, (size, first, times, capacity - group.room)]))
    return done + [g for groups in open_.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces a sequence, first sequence, offset) by length and rank; the number of sequences."""
    stock = Stock(counts)
    rows, sequence = [], 0
    for group in [*reduced(stock, capacity), *best_fit(stock, capacity)]:
        rows += [(size, first, times, sequence, offset) for size, first, times, offset in group.parts]
        sequence += group.bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


# The whole table.


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Each of the ``pieces`` with its ``sequence_id`` and its ``offset`` there; columns part and at go.

    The driver gets a count for each length, at most ``capacity`` of them.
    """
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    shift = by_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    totals = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    table, _ = plan({r["length"]: r["n"] for r in totals}, capacity)
    wide = np.int64(1 << 40)

    def place(batches: Batches) -> Batches:
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            size, first, times, sequence, offset = table[np.searchsorted(keys, length * wide + rank, side="right") - 1].T
            place_in, order = sequence + (rank - first) // times, offset + (rank - first) % times * size
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place_in), pa.array(order)], [*names, "sequence_id", "offset"])

    ranked = cut.join(shift, ["length", "part"]).withColumn("rank", F.col("at") + F.col("before"))
    kept = cut.drop("part", "at").schema
    names = kept.names
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian, 32 bits each), and the start and key of each piece."""
    key = placed.columns[0]
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(f"`{key}`").alias("key"), "piece", "ids")))
    gathered = placed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda total, p: F.concat(total, p["ids"]))
    named = F.transform("p", lambda p: F.struct(p["offset"].alias("offset"), p["key"].alias(key), p["piece"].alias("piece")))
    return gathered.select("sequence_id", joined.alias("ids"), named.alias("pieces"))
