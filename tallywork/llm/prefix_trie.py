"""The trie of conversations by their first turns, with totals of every subtree by tree contraction.

A node stands for a sequence of first turns, (role, text) each; its members are the
conversations that start with it. Each turn has a digest of its place, role and text, and a
sequence the sums of its turns' digests in four parts of 32 bits, so the digests of all prefixes
of a conversation are running sums: no conversation is walked turn by turn, however long, and
rows of one prefix are aggregated, however many. Two prefixes share a digest of 128 bits with a
negligible probability.

Totals of subtrees are found by parallel contraction. A round rakes the leaves, which adds what
they hold to their parents, and compresses chains: of the nodes with one child, an independent
set (chosen by coins that a digest throws) is spliced out, and the child carries what the node
held past it. Rounds grow with the logarithm of the number of nodes, not with the depth, and work
on what is left, a fixed share less each time. Then the spliced nodes are put back, the last
ones first, each with the total of the child it had. Every round is a table in the shared folder.

A conversation's turns are placed by the rows' order over all conversations, dealt by range, so
a conversation that holds a third of all rows is many tasks' work; counts and sums of the parts of
a conversation shift those of later parts.

Defined results: rows without an id take no part; turns are ordered by turn (null first), then
role and text, and null roles and texts are empty; repeated rows are turns of their own; an empty
table has no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import Batches
from tallywork.operators.stages import written

#: A turn's digest is summed in this many parts of 32 bits.
PARTS = 4
SUMS = [f"s{i}" for i in range(PARTS)]
#: Ids that agree but for so many bits are joined into one text before a node's texts are hashed.
RUN_BITS = 10


def placed_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Per turn: conv, part (a task's number), at (its place in the conversation within the part), digest, chars."""
    chosen = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # The length of the role keeps (ab, c) and (a, bc) apart.
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    ranged = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    narrow = ranged.select("conv", F.spark_partition_id().alias("part"), digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))

    def count(batches: Batches) -> Batches:
        last, seen = None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            at = np.arange(1, len(conv) + 1) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                head = first[1] if len(first) > 1 else len(conv)
                at[:head] += seen
            last, seen = conv[-1], at[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "at"])

    return written(narrow.mapInArrow(count, "conv long, part int, digest string, chars long, at long"), "turns")


def shifted(values: DataFrame, keys: list[str], part: str, sums: dict[str, Column]) -> DataFrame:
    """Per ``keys`` and ``part``: each of ``sums`` over the earlier parts of the keys, under its name."""
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = values.groupBy(*keys, part).agg(*(c.alias(n) for n, c in sums.items()))
    return whole.select(*keys, part, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums))


def rebuilt(turns: DataFrame, head: Column, base: Column, most_head: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like others: turns (conv, part, depth, digest, chars) and lengths (conv, length).

    Of a conversation ``conv``, the first ``head`` turns are those of conversation ``base`` (none if
    that is absent), at most ``most_head`` of them; its own turns follow after as many. ``turns`` are as
    ``placed_turns`` gives them.
    """
    before = shifted(turns, ["conv"], "part", {"before": F.count("*")})
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size")).select("conv", "size", head.alias("head"), base.alias("base"))
    lent = sizes.select(F.col("conv").alias("base"), F.col("size").alias("there"))
    sizes = sizes.join(lent, "base", "left").withColumn("lent", F.least("head", F.coalesce("there", F.lit(0))))
    sizes = written(sizes.select("conv", "base", "head", "lent", (F.col("lent") + F.greatest(F.col("size") - F.col("head"), F.lit(0))).alias("length")), "conversations")
    # Only the first turns of a conversation can be lent.
    firsts = turns.where(F.col("at") <= most_head).join(before, ["conv", "part"]).withColumn("depth", F.col("at") + F.col("before")).where(F.col("depth") <= most_head)
    heads = sizes.where("lent > 0").join(firsts.select(F.col("conv").alias("base"), "depth", "digest", "chars"), "base").where("depth <= lent")
    # What a conversation is shifted by is looked up once for each of its parts, not for each turn.
    by_part = before.join(sizes, "conv").select("conv", "part", "head", "lent", "before")
    own = turns.join(by_part, ["conv", "part"]).withColumn("place", F.col("at") + F.col("before")).where("place > head")
    own = own.withColumn("depth", F.col("place") - F.col("head") + F.col("lent"))
    columns = ["conv", "part", "depth", "digest", "chars"]
    every = own.select(*columns).unionByName(heads.withColumn("part", F.lit(-1)).select(*columns))
    return written(every, "rebuilt"), sizes.select("conv", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn (conv, part, depth, digest, chars): conv, depth, chars, ``node`` and ``parent``, digests of what it ends and follows."""
    hashed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"))
    own = turns.select(
        "conv", "part", "depth", "chars", *(F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(SUMS)),
    )
    before = shifted(own, ["conv"], "part", {f"before_{s}": F.sum(s) for s in SUMS})
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = own.select("conv", "part", "depth", "chars", *SUMS, *(F.sum(s).over(so_far).alias(f"upto_{s}") for s in SUMS)).join(before, ["conv", "part"])
    ends = [F.col(f"upto_{s}") + F.col(f"before_{s}") for s in SUMS]
    return running.select(
        "conv", "depth", "chars", node_key(F.col("depth"), ends).alias("node"),
        node_key(F.col("depth") - 1, [e - F.col(s) for e, s in zip(ends, SUMS)]).alias("parent"),
    )


def node_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))


def nodes_of(every: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, parent, depth, conv_id, n_convs, chars) of turns as ``prefixes`` gives them, and ends (node, conv)."""
    root = node_key(F.lit(0), [F.lit(0)] * PARTS)
    tops = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), root.alias("node"), F.lit(None).cast("binary").alias("parent"))
    rows = every.unionByName(tops)
    grouped = rows.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"),
    )
    # A conversation's last node is one without a turn behind it: the deepest of its rows.
    last = rows.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))
    return written(grouped, "nodes"), last


def ends_digest(ends: DataFrame) -> DataFrame:
    """Per node: ``ends_sha256``, of its conversations' ids in order, comma-joined.

    Ids are joined in runs of neighbouring numbers first; a node's runs stream through one hash in
    their order, and none is held longer than it takes.
    """
    run = F.shiftright("conv", RUN_BITS)
    runs = ends.groupBy("node", run.alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Batches) -> Batches:
        node, sha = None, None
        for batch in batches:
            done = []
            for here, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if here != node:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = here, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    return runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


# Contraction.


def _heads(node: Column, turn: int) -> Column:
    """A coin that every run throws alike."""
    return F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(2)) == 0


def subtree_totals(tree: DataFrame, values: list[str], observe: Callable[[int, int], None] | None = None) -> DataFrame:
    """Per node of a ``tree`` (node, parent, and ``values``): node and the sum of each value over its subtree, itself included.

    Keys are binary; the root has no parent. ``observe`` gets each round's number and the nodes it began with.
    """
    lifts = [f"lift_{v}" for v in values]
    # What a node hands its parent is what it holds (the value) and what was spliced out above it (the lift).
    state = tree.select("node", "parent", *(F.col(v).cast("long").alias(v) for v in values), *(F.lit(0).cast("long").alias(x) for x in lifts))
    kids = state.groupBy("parent").agg(F.count("*").alias("n"))
    state = state.join(kids.select(F.col("parent").alias("node"), "n"), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    start = state = written(state, "trie")
    # A node is done at once if it never had a child, else in the round that takes its last one.
    finished, rounds = [start.where("n = 0").select("node", *values)], []
    while True:
        counted = state.agg(F.count("*"), F.count(F.when(F.col("n") > 0, 1))).first()
        if observe:
            observe(len(rounds), counted[0])
        if not counted[1]:
            break
        leaf = F.col("n") == 0
        inner = F.struct("node", *lifts)
        handed = state.groupBy("parent").agg(
            F.count(F.when(leaf, 1)).alias("raked"), F.min(F.when(~leaf, inner)).alias("only"),
            *(F.coalesce(F.sum(F.when(leaf, F.col(v) + F.col(x))), F.lit(0)).alias(f"got_{v}") for v, x in zip(values, lifts)),
        )
        parents = state.where(~leaf).join(handed.withColumnRenamed("parent", "above"), F.col("node") == F.col("above"))
        left = F.col("n") - F.col("raked")
        turn = len(rounds)
        spliced = (left == 1) & F.col("parent").isNotNull() & _heads(F.col("node"), turn) & ~_heads(F.col("only.node"), turn)
        now = written(
            parents.select("node", "parent", left.alias("n"), *((F.col(v) + F.col(f"got_{v}")).alias(v) for v in values), *lifts, "only", spliced.alias("spliced")), "trie",
        )
        rounds.append(now)
        finished.append(now.where("n = 0").select("node", *values))
        gone = now.where("spliced").select(
            F.col("only.node").alias("node"), F.col("parent").alias("over"), *((F.col(v) + F.col(x)).alias(f"more_{v}") for v, x in zip(values, lifts)),
        )
        state = now.where("NOT spliced").select("node", "parent", "n", *values, *lifts).join(gone, "node", "left").select(
            "node", F.coalesce("over", "parent").alias("parent"), "n", *values, *((F.col(x) + F.coalesce(f"more_{v}", F.lit(0))).alias(x) for v, x in zip(values, lifts)),
        )
        state = written(state, "trie")
    # A spliced node's total is what it held, what its child had in lift then, and its child's total.
    # The child was left in a later round, or lost its last child in this one.
    later = None
    for now in reversed(rounds):
        ended = finished.pop()
        later = ended if later is None else later.unionByName(ended)
        total = now.where("spliced").select(F.col("node").alias("again"), F.col("only.node").alias("node"), *((F.col(v) + F.col(f"only.{x}")).alias(f"own_{v}") for v, x in zip(values, lifts)))
        put_back = total.join(later, "node").select(F.col("again").alias("node"), *((F.col(f"own_{v}") + F.col(v)).alias(v) for v in values))
        later = later.unionByName(written(put_back, "totals"))
    return reduce(DataFrame.unionByName, [f for f in [later, *finished] if f is not None])


def trie(nodes: DataFrame, ends: DataFrame, observe: Callable[[int, int], None] | None = None) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    kids = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).select(F.col("parent").alias("node"), "n_children")
    each = written(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    weights = each.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(weights, ["n_leaves", "saved_tokens"], observe)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = each.select("node", "parent", "conv_id", "depth", "n_convs", "n_children").join(totals, "node").join(ends_digest(ends), "node", "left")
    return named.join(above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame, head: Column, base: Column, most_head: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    observe: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """The trie of ``turns``, each conversation rebuilt as ``rebuilt`` says; ``head`` and ``base`` are of a column conv."""
    every, lengths = rebuilt(placed_turns(turns, conv, turn, role, text), head, base, most_head)
    return trie(*nodes_of(written(prefixes(every), "prefixes"), lengths), observe)
