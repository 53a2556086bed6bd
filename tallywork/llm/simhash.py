"""SimHash near-dedup with a Gray-order hierarchical index.

Each distinct fingerprint is dealt into one bucket per band of its bits; two that differ in at
most ``distance`` bits agree in one of ``distance`` + 1 bands. A bucket beyond ``split_above``
is dealt again by bands of the bits that are left, so that a crowd of near copies is shared out
too. Within a bucket fingerprints are sorted by Gray rank, which puts similar ones side by side;
nodes of the index hold the bits their fingerprints share, an upper node what its children
share. A search goes down from the root and adds up the differences in the bits that each level
adds; beyond ``distance`` the whole group is left out.

Two fingerprints are offered. A narrow one of 64 bits, of shingles with repeats, links at a given
number of differing bits. A wide one of 256 bits, of distinct shingles, so that a phrase said over
and over counts once, links by similarity: near copies of Jaccard similarity 0.8 differ in
about 15 % of the bits, too many for any band of 64 bits to agree on, so sixteen parts of 16 bits
are searched each for itself within 1 bit. At 0.8 a part finds a pair with probability 0.28, all
sixteen with 0.995. Two found are candidates if the whole fingerprints differ in no more bits
than the similarity allows, and linked if the sets of shingles of two texts, one of each
fingerprint, have the similarity. Texts of one wide fingerprint are linked without comparing.

Links of fingerprints are not listed: a search skips a group that is already in its own
component, and a task gives no more edges than join its components up. Edges of candidates make
neighbourhoods, each of which is then compared text by text: a neighbourhood that fits is one
task's work, a larger one is dealt into blocks, every two of which meet in a task. Shared shingles
of all pairs are counted there at once, and again only edges that join up linked texts leave the
task. So a crowd of texts that are close to the similarity but not linked costs comparisons, no
rows; and a link is found also where the search met its ends by way of others only.
Components over all tasks are joined up in Spark.

Defined results: a null text, or one without words, has fingerprint 0, linked like any other; a
text of fewer words than a shingle is one shingle; repeated rows repeat; a component whose ids
are all null has a null id, and null ids are otherwise passed over; an empty table gives no
rows. Other columns are not read by ``near_copies`` and kept by ``one_of_each``.
"""

from __future__ import annotations


import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import Batches, free_name
from tallywork.llm.components import components
from tallywork.operators.stages import written

SEED, BITS = 42, 64
#: The wide fingerprint: words of 64 bits, and bits and allowed differences of a part.
WIDE_WORDS, PART_BITS, PART_DISTANCE = 4, 16, 1
#: Differing bits of candidates beyond the expected number, in standard deviations.
TOLERANCE = 4.0
# Fixed values of a well-known mixing function of 64-bit numbers.
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPLIT_ABOVE = 1 << 20
FAN = 8
PAIRS_AT_ONCE = 1 << 20
ASKING_AT_ONCE = 1 << 14
#: Texts and shingles of a block of a neighbourhood; two blocks meet in a task.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: A shingle in this share of a block's texts is counted by a product of matrices, others by their texts.
DENSE_SHARE = 1 / 16
SHINGLES_AT_ONCE = 1 << 12

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For each byte value, its eight bits, the lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_PLACES = np.arange(8) * 256


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    size = min(shingle, len(words))
    count = len(words) - size + 1 if words else 0
    shingles = map(b" ".join, zip(*(words[i : i + count] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)


def majority(hashed: np.ndarray) -> bytes:
    """Bits set in over half of the hashes, the lowest byte first."""
    seen = np.bincount((hashed.view(np.uint8).reshape(-1, 8) + BYTE_PLACES).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits((seen @ BYTE_BITS).ravel() * 2 > len(hashed), bitorder="little").tobytes()


def fingerprint(text: str | None, shingle: int) -> int:
    """The narrow fingerprint as a signed number."""
    return int.from_bytes(majority(hashes(text, shingle)), "little", signed=True)


def wide_fingerprint(text: str | None, shingle: int) -> bytes:
    """The wide fingerprint: the narrow one of the distinct shingles by several hash functions, mixed out of one."""
    first, out = np.unique(hashes(text, shingle)), []
    for word in range(WIDE_WORDS):
        mixed = first + np.uint64(GOLDEN * (word + 1) % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(30))) * MIX_1
        mixed = (mixed ^ (mixed >> np.uint64(27))) * MIX_2
        out.append(majority(mixed ^ (mixed >> np.uint64(31))))
    return b"".join(out)


def most_differing(similarity: float, tolerance: float = TOLERANCE) -> int:
    """Differing bits of wide fingerprints of candidates for this Jaccard similarity."""
    bits = WIDE_WORDS * BITS
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + tolerance * math.sqrt(bits * share * (1 - share)))


def fingerprints(documents: DataFrame, key: str, text: str, shingle: int, wide: bool = False) -> DataFrame:
    """Per document: ``key`` and ``print``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            prints = [(wide_fingerprint if wide else fingerprint)(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints, pa.binary() if wide else pa.int64())], ["key", "print"])

    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(run, f"key {chosen.schema['key'].dataType.simpleString()}, print {'binary' if wide else 'long'}")


# The index.


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Level:
    """Nodes of one level: shared bits and their values, children in the level below, last leaf."""

    def __init__(self, value: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray):
        self.value, self.mask, self.starts, self.ends, self.last = value, mask, starts, ends, last


class GrayIndex:
    """A tree per bucket over fingerprints sorted by bucket and Gray rank."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, self.codes = order, codes[order]
        n = len(codes)
        places = np.arange(n)
        self.levels = [Level(self.codes, np.full(n, ~np.uint64(0)), places, places + 1, places)]
        self.bucket = np.concatenate(([0], np.cumsum(np.diff(bucket[order]) != 0))) if n else places
        owner = self.bucket
        while n and len(owner) > owner[-1] + 1:
            below = self.levels[-1]
            first = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
            inside = np.arange(len(owner)) - first[owner]
            starts = np.flatnonzero(inside % FAN == 0)
            ends = np.append(starts[1:], len(owner))
            value = below.value[starts]
            differ = np.bitwise_or.reduceat(below.value ^ np.repeat(value, ends - starts), starts)
            mask = np.bitwise_and.reduceat(below.mask, starts) & ~differ
            self.levels.append(Level(value & mask, mask, starts, ends, below.last[ends - 1]))
            owner = owner[starts]

    def pairs(self, asking: np.ndarray, distance: int, label: np.ndarray, uniform: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (i, j), i asking and j behind it, within ``distance``, not yet known to be of one component.

        ``label`` is the component of each leaf, ``uniform`` per level the component of nodes
        whose leaves have one only, else -1.
        """
        top = self.levels[-1]
        query, node = asking, self.bucket[asking]
        differ = np.bitwise_count((self.codes[query] ^ top.value[node]) & top.mask[node]).astype(np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = (differ <= distance) & (level.last[node] > query) & (uniform[depth][node] != label[query])
            query, node, differ = query[keep], node[keep], differ[keep]
            if not depth or not len(query):
                break
            sizes = level.ends[node] - level.starts[node]
            if sizes.sum() > PAIRS_AT_ONCE and len(asking) > 1:
                halves = [self.pairs(part, distance, label, uniform) for part in np.array_split(asking, 2)]
                return tuple(np.concatenate(x) for x in zip(*halves))
            offsets = np.cumsum(sizes) - sizes
            child = np.repeat(level.starts[node] - offsets, sizes) + np.arange(sizes.sum())
            above = np.repeat(level.mask[node], sizes)
            query, differ = np.repeat(query, sizes), np.repeat(differ, sizes)
            lower = self.levels[depth - 1]
            node = child
            differ = differ + np.bitwise_count((self.codes[query] ^ lower.value[node]) & lower.mask[node] & ~above)
        return query, node

    def uniform_labels(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level: the label all leaves of a node have, else -1. Leaves answer to themselves."""
        low = high = label
        out = [label]
        for level in self.levels[1:]:
            low, high = np.minimum.reduceat(low, level.starts), np.maximum.reduceat(high, level.starts)
            out.append(np.where(low == high, low, -1))
        return out


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of each pair; every node points to the least of its component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def linked(bucket: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that has links in these buckets: its place, and that of one it reaches. Equal fingerprints have one place."""
    _, place, number = np.unique(codes, return_index=True, return_inverse=True)
    index = GrayIndex(bucket, codes.view(np.uint64))
    number = number[index.order]
    root = np.arange(len(place))
    start, step = 0, 256
    while start < len(codes):
        label = root[number]
        i, j = index.pairs(np.arange(start, min(start + step, len(codes))), distance, label, index.uniform_labels(label))
        root = merge(root, number[i], number[j])
        start, step = start + step, step * 2
    moved = np.flatnonzero(root != np.arange(len(place)))
    return place[moved], place[root[moved]]


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join the trees of each pair as ``merge`` does; of the pairs, the first ones first, those that join two trees."""
    out = [(a[:0], b[:0])]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root, *(np.concatenate(ends) for ends in zip(*out))
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        _, first = np.unique(np.maximum(x, y), return_index=True)
        out.append((a[first], b[first]))
        root = merge(root, *out[-1])


def close_pairs(bucket: np.ndarray, codes: np.ndarray, whole: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that join up all whose ``whole`` fingerprints (rows of words) differ in at most ``most`` bits.

    Only those whose parts ``codes`` meet in a bucket are compared.
    """
    _, place, number = np.unique(whole.view(f"V{whole.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    index = GrayIndex(bucket, codes.view(np.uint64))
    number = number[index.order]
    root = np.arange(len(place))
    out = [(place[:0], place[:0])]
    start, step = 0, 256
    while start < len(codes):
        label = root[number]
        i, j = index.pairs(np.arange(start, min(start + step, len(codes))), PART_DISTANCE, label, index.uniform_labels(label))
        start, step = start + step, min(2 * step, ASKING_AT_ONCE)
        if len(i):
            i, j = number[i], number[j]
            pieces = zip(*(np.array_split(x, len(i) // PAIRS_AT_ONCE + 1) for x in (i, j)))
            keep = np.concatenate([np.bitwise_count(whole[place[a]] ^ whole[place[b]]).sum(axis=1) <= most for a, b in pieces])
            root, i, j = forest(root, i[keep], j[keep])
            out.append((i, j))
    return tuple(place[np.concatenate(ends)] for ends in zip(*out))


def shared_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``first`` shares with each of ``second``."""
    sizes = [np.array([len(x) for x in sets], np.int64) for sets in (first, second)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    values = [np.concatenate(sets) if sets else np.zeros(0, np.int64) for sets in (first, second)]
    _, number = np.unique(np.concatenate(values), return_inverse=True)
    numbers = number[: len(values[0])], number[len(values[0]) :]
    counts = [np.bincount(n, minlength=len(number)) for n in numbers]
    shared = np.zeros((len(first), len(second)), np.int64)
    both = (counts[0] > 0) & (counts[1] > 0)
    dense = both & (counts[0] > DENSE_SHARE * len(first)) & (counts[1] > DENSE_SHARE * len(second))
    column = np.cumsum(dense) - 1
    total = int(dense.sum())
    for at in range(0, total, SHINGLES_AT_ONCE):
        sides = []
        for n, r, size in zip(numbers, rows, map(len, (first, second))):
            here = dense[n] & (column[n] >= at) & (column[n] < at + SHINGLES_AT_ONCE)
            side = np.zeros((size, min(SHINGLES_AT_ONCE, total - at)), np.float32)
            side[r[here], column[n[here]] - at] = 1
            sides.append(side)
        shared += (sides[0] @ sides[1].T).astype(np.int64)
    # A rarer value meets all that have it on the other side.
    rare = both & ~dense
    ends = []
    for n, r in zip(numbers, rows):
        here = np.flatnonzero(rare[n])
        here = here[np.argsort(n[here], kind="stable")]
        ends.append((n[here], r[here]))
    (value, one), (values_there, other) = ends
    begins, stops = np.searchsorted(values_there, value), np.searchsorted(values_there, value, side="right")
    meets = stops - begins
    flat = shared.ravel()
    for part in np.array_split(np.arange(len(value)), int(meets.sum()) // PAIRS_AT_ONCE + 1):
        n = meets[part]
        there = np.repeat(begins[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        flat += np.bincount(np.repeat(one[part], n) * len(second) + other[there], minlength=flat.size)
    return shared


def similar(first: list[np.ndarray], second: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of sets whose Jaccard similarity is at least this."""
    shared = shared_counts(first, second)
    sizes = [np.array([len(x) for x in sets], np.int64) for sets in (first, second)]
    return np.nonzero((shared > 0) & (shared / np.maximum(sizes[0][:, None] + sizes[1] - shared, 1) >= similarity))


# The whole table.


def buckets(codes: DataFrame, bits: int, distance: int, split_above: int) -> DataFrame:
    """Each row (print, code, path) in each of its buckets, with the bucket's digest as path.

    Digests may coincide: buckets that fall together are searched together.
    """
    open_ = codes.select("print", "code", F.col("code").alias("rest"), "path")
    free, out = bits, None
    while True:
        width = free // (distance + 1)
        bands = []
        for band in range(distance + 1):
            at = band * width
            size = width if band < distance else free - at
            value = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << size) - 1))
            above = F.shiftleft(F.shiftrightunsigned("rest", at + size), at) if at + size < BITS else F.lit(0).cast("long")
            rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << at) - 1).cast("long")))
            bands.append(F.struct(F.xxhash64("path", F.lit(free), F.lit(band), value).alias("path"), rest.alias("rest")))
        dealt = open_.select("print", "code", F.explode(F.array(*bands)).alias("b")).select("print", "code", "b.path", "b.rest")
        free -= width
        hot = None
        if free > distance + 1:
            hot = written(dealt.groupBy("path").count().where(F.col("count") > split_above).select("path"), "hot")
        if hot is None or hot.isEmpty():
            part = dealt.select("path", "code", "print")
            return part if out is None else out.unionByName(part)
        part = dealt.join(hot, "path", "left_anti").select("path", "code", "print")
        out = part if out is None else out.unionByName(part)
        open_ = dealt.join(hot, "path", "left_semi")


def links(prints: DataFrame, distance: int, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Edges (a, b) that join up all narrow fingerprints within ``distance``, fewer than there are links."""

    def run(batches: Batches) -> Batches:
        held = [(b.column("path").to_numpy(), b.column("code").to_numpy()) for b in batches]
        if held:
            path, codes = (np.concatenate(x) for x in zip(*held))
            a, b = linked(path, codes, distance)
            yield pa.RecordBatch.from_arrays([pa.array(codes[a], pa.int64()), pa.array(codes[b], pa.int64())], ["a", "b"])

    codes = prints.select("print", F.col("print").alias("code"), F.lit(0).cast("long").alias("path"))
    return buckets(codes, BITS, distance, split_above).repartition("path").mapInArrow(run, "a long, b long")


def wide_pairs(prints: DataFrame, similarity: float, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Edges (a, b) that join up all wide fingerprints found to be candidates for this similarity."""
    most = most_differing(similarity)

    def run(batches: Batches) -> Batches:
        held = [(b.column("path").to_numpy(), b.column("code").to_numpy(), b"".join(b.column("print").to_pylist())) for b in batches]
        if held:
            path, codes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            whole = np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(-1, WIDE_WORDS)
            ends = close_pairs(path, codes, whole, most)
            for at in range(0, len(ends[0]), ASKING_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array([whole[i].tobytes() for i in end[at : at + ASKING_AT_ONCE]], pa.binary()) for end in ends], ["a", "b"])

    size = PART_BITS // 8
    parts = [
        F.struct(F.conv(F.hex(F.substring("print", 1 + i * size, size)), 16, 10).cast("long").alias("code"), F.lit(i).cast("long").alias("path"))
        for i in range(WIDE_WORDS * BITS // PART_BITS)
    ]
    codes = prints.select("print", F.inline(F.array(*parts)))
    found = buckets(codes, PART_BITS, PART_DISTANCE, split_above).repartition("path").mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(documents: DataFrame, key: str, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """Per fingerprint of ``wanted`` (print, least): ``print`` and ``shingles``, the distinct hashes of a text that has it."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sets = pa.array([np.unique(hashes(t, shingle)).view(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([wide_fingerprint(t, shingle) for t in texts], pa.binary()), sets], ["print", "shingles"])

    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    keys = wanted.select(F.col("least").alias("key")).where("key IS NOT NULL").distinct()
    unnamed = wanted.where("least IS NULL").select("print")
    named = chosen.join(keys, "key", "left_semi").select("text")
    rows = named if unnamed.isEmpty() else named.unionByName(chosen.where("key IS NULL").select("text"))
    found = rows.mapInArrow(run, "print binary, shingles array<bigint>").join(wanted.select("print"), "print", "left_semi")
    return found.groupBy("print").agg(F.min("shingles").alias("shingles"))


def linked_texts(sets: DataFrame, similarity: float, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges (a, b) that join up all of one neighbourhood with this similarity, from (root, print, shingles).

    A neighbourhood is dealt into as many blocks as its texts and shingles need; every two meet.
    """
    size = F.size("shingles").cast("long")
    whole = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("size") / block_shingles), F.lit(1)).cast("long")
    dealt = sets.join(whole.select("root", blocks.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("root", "print", "shingles", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(held: pa.Table) -> pa.Table:
        prints, block = held.column("print").to_pylist(), held.column("block").to_numpy()
        lists = held.column("shingles").combine_chunks()
        values, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        texts = [values[at[i] : at[i + 1]] for i in range(len(prints))]
        one = np.flatnonzero(block == held.column("low")[0].as_py())
        other = np.flatnonzero(block == held.column("high")[0].as_py())
        i, j = similar([texts[x] for x in one], [texts[x] for x in other], similarity)
        i, j = one[i], other[j]
        _, i, j = forest(np.arange(len(prints)), i[i != j], j[i != j])
        return pa.table({n: pa.array([prints[x] for x in end], pa.binary()) for n, end in (("a", i), ("b", j))})

    return met.groupBy("root", "low", "high").applyInArrow(compare, "a binary, b binary")


def wide_links(documents: DataFrame, key: str, text: str, shingle: int, distinct: DataFrame, similarity: float, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Edges (a, b) that join up all wide fingerprints (print, least) whose texts have this Jaccard similarity."""
    near = components(written(wide_pairs(distinct.select("print"), similarity, split_above), "near-pairs"))
    near = near.select(F.col("node").alias("print"), "root")
    near = written(near.unionByName(near.select(F.col("root").alias("print"), "root").distinct()), "near-prints")
    wanted = written(distinct.join(near, "print", "left_semi"), "near-prints")
    sets = written(shingle_sets(documents, key, text, shingle, wanted).join(near, "print"), "shingle-sets")
    return linked_texts(sets, similarity)


def near_copies(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, similarity: float | None = None,
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Per document: its key, ``print`` (the fingerprint) and ``component_id`` (the least key reachable).

    Narrow fingerprints link at ``distance``; given a ``similarity``, wide ones are taken, and
    links are verified by the texts. Fingerprints are written once, without texts.
    """
    each = written(fingerprints(documents, key, text, shingle, wide=similarity is not None), "prints")
    distinct = written(each.groupBy("print").agg(F.min("key").alias("least")), "distinct-prints")
    if similarity is None:
        edges = links(distinct.select("print"), distance, split_above)
    else:
        edges = wide_links(documents, key, text, shingle, distinct, similarity, split_above)
    roots = components(edges)
    rooted = distinct.join(roots.select(F.col("node").alias("print"), "root"), "print", "left")
    rooted = rooted.select("print", "least", F.coalesce("root", "print").alias("root"))
    # Only fingerprints that are linked need the least key of their component.
    grouped = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print", "root").join(grouped, "root").select("print", "component_id")
    return each.join(named, "print").select(F.col("key").alias(key), "print", "component_id")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` whose key is the least of their component.

    Rows of one key stay or go together; so do rows without a key, which stay if all their
    component has none.
    """
    other = free_name("removed_key", documents.columns)
    found = near_copies(documents, key, text, **options)
    extra = written(found.where(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(f"`{key}`").alias(other)).distinct(), "near-copies")
    return documents.join(extra, documents[f"`{key}`"].eqNullSafe(extra[other]), "left_anti")
