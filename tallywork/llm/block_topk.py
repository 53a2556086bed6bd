"""Exact top-k by inner product, block by block.

Vectors are made of whole numbers: floor(scale * component). Candidates are dealt into groups
of bounded size by a digest of their id, queries into groups of theirs, and each pair of groups
is a task of its own. There the candidates are sorted so that similar ones are neighbours and
cut into blocks; a block keeps the greatest and least value of each component and its vectors
as a forward index. A query visits blocks from the highest bound down and stops when the next
bound is below its k-th best score (one that equals it may win a tie by a smaller id).

Of candidates with equal vectors only the k + 1 smallest ids can be among any query's k best,
so no others are compared, however many copies there are.

Defined results: vectors null, or with a null or non-finite component, take no part, nor do
rows without an id; missing components of shorter vectors are 0; rows of one id and vector are
one row; an id with several vectors asks once for each, and rows of the query's own id are never
its results; a score beyond 64 bits counts as the nearest 64-bit number. With fewer candidates
than k there are fewer ranks. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
GROUP_CANDIDATES, GROUP_QUERIES = 16384, 4096
LONG_MAX = (1 << 63) - 1


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width, shorter ones filled with 0."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Products:
    """Inner products without error: in doubles if all sums fit, else in 64 bits, else in Python's numbers."""

    def __init__(self, queries: np.ndarray, candidates: np.ndarray):
        most = np.abs(queries).sum(axis=1).max(initial=0) * np.abs(candidates).max(initial=0)
        if most < 2**53:
            self.kind = np.float64
        elif most < 2**62:
            self.kind = np.int64
        else:
            self.kind = object

    def of(self, values: np.ndarray) -> np.ndarray:
        if self.kind is object:
            return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)
        return values.astype(self.kind)


def in_64_bits(values: np.ndarray) -> np.ndarray:
    """Python's numbers cut to 64 bits; other kinds are within them."""
    return np.clip(values, -LONG_MAX - 1, LONG_MAX) if values.dtype == object else values


def kept_best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best, by score and then by smaller id, sorted."""
    if score.dtype == object:
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(query)) + 1)) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.concatenate((first, [len(query)]))))
    top = rank < k
    return query[top], score[top], ids[top]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the query, score and id of the k best candidates of each query."""
    exact = Products(queries, candidates)
    # Similar vectors become neighbours: by the signs of the components that vary most.
    varied = np.argsort(-candidates.var(axis=0), kind="stable")[:16]
    place = np.lexsort((ids, *(candidates[:, d] for d in varied[:1]), *(candidates[:, d] > 0 for d in varied[::-1])))
    ids, candidates = ids[place], candidates[place]
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(candidates, starts), np.minimum.reduceat(candidates, starts)
    asked, forward = exact.of(queries), exact.of(candidates)
    positive, negative = exact.of(np.maximum(queries, 0)), exact.of(np.minimum(queries, 0))
    bounds = in_64_bits(positive @ exact.of(high).T + negative @ exact.of(low).T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    sorted_bounds = np.take_along_axis(bounds, order, axis=1)

    none_yet = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min, object: None}[exact.kind]
    floor = np.full(len(queries), none_yet, exact.kind)
    best = (np.zeros(0, np.int64), np.zeros(0, asked.dtype), np.zeros(0, np.int64))
    done, step = 0, 1
    while done < len(starts):
        # The next blocks of every query whose bound reaches its k-th score.
        ahead = slice(done, done + step)
        if exact.kind is object:
            live = np.array([[f is None or b >= f for b in row] for row, f in zip(sorted_bounds[:, ahead], floor)])
        else:
            live = sorted_bounds[:, ahead] >= floor[:, None]
        query, column = np.nonzero(live)
        if not len(query):
            break
        block = order[query, done + column]
        by_block = np.argsort(block, kind="stable")
        query, block = query[by_block], block[by_block]
        found = [best]
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            at, mine = starts[block[part[0]]], query[part]
            theirs = ids[at : at + BLOCK]
            scores = in_64_bits(asked[mine] @ forward[at : at + BLOCK].T)
            wanted = query_ids[mine][:, None] != theirs
            if exact.kind is object:
                wanted &= np.array([[f is None or s >= f for s in row] for row, f in zip(scores, floor[mine])])
            else:
                wanted &= scores >= floor[mine][:, None]
            q, c = np.nonzero(wanted)
            found.append((mine[q], scores[q, c], theirs[c]))
        best = kept_best(*(np.concatenate(x) for x in zip(*found)), k)
        counts = np.bincount(best[0], minlength=len(queries))
        last = np.cumsum(counts) - 1
        full = counts >= k
        floor[full] = best[1][last[full]]
        done, step = done + step, step * 2
    return best


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as doubles, which hold them exactly."""
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    # Doubles beyond 2^52 are whole; adding 0 turns -0 into 0.
    return F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0))


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    group_candidates: int = GROUP_CANDIDATES, group_queries: int = GROUP_QUERIES,
) -> DataFrame:
    """The ``k`` highest scores of each row that ``is_query`` selects against all other rows.

    Columns: query_id, rank (from 1), ``key``, score.
    """
    chosen = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), is_query.alias("asks"))
    # Scaled before it is tested: a component may be finite and its multiple not.
    rows = chosen.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", whole_numbers(F.col("v"), scale).alias("v"), "asks")
    queries = rows.where("asks").select("id", "v").distinct()
    # A rank limit works below the shuffle, so copies of one vector do not gather.
    same = Window.partitionBy("v").orderBy("id")
    candidates = rows.select("id", "v").withColumn("copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).select("id", "v").distinct()

    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    parts, blocks = max(1, -(-counts["n"] // group_candidates)), max(1, -(-counts["q"] // group_queries))
    left = queries.withColumns({
        "block": F.pmod(F.xxhash64("id", "v"), F.lit(blocks)), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))),
    }).withColumn("part", F.col("part").cast("long"))
    right = candidates.withColumns({
        "part": F.pmod(F.xxhash64("id", "v"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
    }).withColumn("block", F.col("block").cast("long"))

    def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": [], "query": []}
        if asking.num_rows and there.num_rows:
            asked, held = asking.column("v").combine_chunks(), there.column("v").combine_chunks()
            width = max(1, *(int(np.diff(a.offsets.to_numpy()).max()) for a in (asked, held)))
            ids = asking.column("id").to_numpy()
            q, s, c = search(ids, matrix(asked, width), there.column("id").to_numpy(), matrix(held, width), k)
            digests = asking.column("digest").to_numpy()
            out = {"query_id": ids[q], "id": c, "score": [int(x) for x in s], "query": digests[q]}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    left = left.withColumn("digest", F.xxhash64("id", "v"))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(compare, "query_id long, id long, score long, query long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
