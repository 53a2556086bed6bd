"""Mixing sources to target weights, in built-in expressions only.

The corpus is a tree, for example of domains, languages and sources. Weights share out a budget
of tokens from the root down: each node gives its children shares in proportion to their
weights, none more than the tokens below it times ``most_epochs``. What a child cannot take goes
to its siblings; only when they are full too is the parent itself short, and its siblings take
the rest. A leaf with more budget than tokens is read in whole epochs and then a part of one: the
documents in a seeded order, new for each epoch, up to the last whose running total is within
the budget.

The order of a leaf is never sorted as a whole: totals of buckets of the seeded digest say in
which bucket the budget ends, and running totals are taken within that one. The cut is two
values per leaf, by which each document is then judged on its own.

Defined results: a null text has no tokens and belongs to every epoch its place falls in; null
names are a node of their own; nodes without a stated weight have ``default_weight``; nodes of
weight 0 take nothing; rows that share a key in a leaf stay or go together; an empty table gives
no rows. Other columns are kept by ``mixed`` and not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import free_name
from tallywork.operators.stages import written

#: Hexadecimal digits of the digest that name a bucket.
BUCKET_DIGITS = 3


def token_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(key: Column, seed: int, epoch: Column) -> Column:
    """The place of a key in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def weight_of(path: list[str], weights: dict[tuple, int], default: int) -> Column:
    """The weight of the node that these columns name."""
    stated = [(names, w) for names, w in weights.items() if len(names) == len(path)]
    cases = [(reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(n)) for c, n in zip(path, names))), w) for names, w in stated]
    out = F.lit(default).cast("long")
    for same, w in reversed(cases):
        out = F.when(same, F.lit(w).cast("long")).otherwise(out)
    return out


def shares(nodes: DataFrame, path: list[str], weights: dict[tuple, int], default: int) -> DataFrame:
    """Children with their ``budget``, from (path, room, parent_budget): shares in proportion to weights, none beyond its room.

    In the order of room over weight the full children come first. A child is full if its own
    level of tokens per weight, reached by all behind it, does not use up the budget.
    """
    siblings = Window.partitionBy(*path[:-1]) if len(path) > 1 else Window.partitionBy(F.lit(0))
    # A tree level has few rows; a parent's children are ordered among themselves.
    order = siblings.orderBy(F.col("fill").asc(), *(F.col(c).asc_nulls_first() for c in path)).rowsBetween(Window.unboundedPreceding, 0)
    weighed = nodes.withColumn("weight", weight_of(path, weights, default)).where("weight > 0 AND room > 0")
    filled = weighed.withColumn("fill", F.col("room").cast("double") / F.col("weight"))
    summed = filled.withColumns({
        "room_so_far": F.sum("room").over(order), "weight_behind": F.sum("weight").over(siblings) - F.sum("weight").over(order),
    })
    full = summed.withColumn("full", F.col("room_so_far") + F.col("fill") * F.col("weight_behind") <= F.col("parent_budget").cast("double"))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(siblings), F.lit(0).cast("long"))
    left = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings), F.lit(0).cast("long"))
    part = (F.col("parent_budget") - taken).cast("double") / F.when(left > 0, left) * F.col("weight")
    return full.select(*path, F.when(F.col("full"), F.col("room")).otherwise(F.floor(part)).cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, path: list[str], budget: int, weights: dict[tuple, int], most_epochs: int, default: int = 1) -> DataFrame:
    """The budget of each leaf of the tree, from (path, tokens)."""
    roomy = leaves.withColumn("room", F.col("tokens") * F.lit(most_epochs).cast("long"))
    parents = None
    for depth in range(1, len(path) + 1):
        level = path[:depth]
        nodes = roomy.groupBy(*level).agg(F.sum("room").alias("room"))
        if parents is None:
            nodes = nodes.withColumn("parent_budget", F.lit(budget).cast("long"))
        else:
            above = parents.select(*(F.col(c).alias(f"_{c}") for c in level[:-1]), F.col("budget").alias("parent_budget"))
            same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in level[:-1]))
            nodes = nodes.join(above, same).select(*level, "room", "parent_budget")
        parents = shares(nodes, level, weights, default)
    return parents


def cuts(documents: DataFrame, path: list[str], budget, weights: dict[tuple, int], most_epochs: int, seed: int, default: int) -> DataFrame:
    """Per leaf: ``whole`` epochs, and the last digest that is in the part epoch (null if none).

    ``documents`` has the path, ``key`` and ``tokens``. ``budget`` is a number, or a share of all
    tokens if below 1.
    """
    leaves = written(documents.groupBy(*path).agg(F.sum("tokens").alias("tokens")), "leaves")
    if budget < 1:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget)
    given = leaf_budgets(leaves, path, budget, weights, most_epochs, default).alias("g")
    same = reduce(Column.__and__, (F.col(f"g.{c}").eqNullSafe(F.col(f"l.{c}")) for c in path))
    plan = given.join(leaves.alias("l"), same).select(*(F.col(f"g.{c}").alias(c) for c in path), "budget", "tokens")
    plan = plan.withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.expr("budget - whole * tokens"))
    plan = written(plan.select(*path, "whole", "rest"), "leaf-plan")

    ordered = in_leaf(documents, plan, path).select(*path, "rest", "tokens", seeded(F.col("key"), seed, F.col("whole")).alias("place"))
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    leaf = Window.partitionBy(*path)
    sums = ordered.groupBy(*path, "rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    before = sums.withColumn("before", F.sum("tokens").over(leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    # The budget ends in the last bucket whose predecessors fit.
    last = before.where("before <= rest").groupBy(*path).agg(F.max(F.struct("bucket", "before")).alias("end"))
    last = written(last.select(*path, "end.bucket", "end.before"), "leaf-buckets")
    inside = in_leaf(ordered, last, path).where(bucket == F.col("bucket"))
    running = F.sum("tokens").over(leaf.orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    fitting = inside.withColumn("total", running + F.col("before")).where("total <= rest").groupBy(*path).agg(F.max("place").alias("cut"))
    # All of the earlier buckets are in, even if nothing of the last one is.
    joined = last.alias("b").join(fitting.alias("f"), reduce(Column.__and__, (F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in path)), "left")
    ends = joined.select(*(F.col(f"b.{c}").alias(c) for c in path), F.coalesce("f.cut", "b.bucket").alias("cut"))
    return written(in_leaf(plan, ends, path, "left").select(*path, "whole", "cut"), "leaf-cuts")


def in_leaf(rows: DataFrame, leaves: DataFrame, path: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their leaf. The leaves are a table, whose size Spark knows."""
    named = leaves.select(*(F.col(c).alias(f"_{c}") for c in path), *(c for c in leaves.columns if c not in path))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path))
    return rows.join(named, same, how).drop(*(f"_{c}" for c in path))


def mixed(
    documents: DataFrame, tree: dict[str, Column], budget, weights: dict[tuple, int], key: str = "doc_id", text: str = "text",
    most_epochs: int = 2, seed: int = 0, default_weight: int = 1, epoch: str = "epoch",
) -> DataFrame:
    """A row of ``documents`` for each epoch that selects it, with one more column: the epoch from 0.

    ``tree`` names the levels from the root down; ``weights`` has whole numbers by path, such as
    ``("web",)`` or ``("web", "en")``. ``budget`` is a number of tokens, or a share of all tokens if
    below 1. The leaves' tables are narrow and written to the shared folder.
    """
    path = [f"level{i}" for i in range(len(tree))]
    narrow = documents.select(
        *(c.alias(p) for p, c in zip(path, tree.values())), F.col(f"`{key}`").alias("key"), token_count(F.col(f"`{text}`")).alias("tokens"),
    )
    narrow = written(narrow, "mixing")
    found = cuts(narrow, path, budget, weights, most_epochs, seed, default_weight)
    own = {p: free_name(p, documents.columns) for p in [*path, "whole", "cut"]}
    result = free_name(epoch, [*documents.columns, *own.values()])
    keyed = documents.withColumns({own[p]: c for p, c in zip(path, tree.values())})
    ends = found.select(*(F.col(p).alias(f"{own[p]}_end") for p in path), *(F.col(c).alias(own[c]) for c in ("whole", "cut")))
    same = reduce(Column.__and__, (F.col(own[p]).eqNullSafe(F.col(f"{own[p]}_end")) for p in path))
    place = seeded(F.col(f"`{key}`"), seed, F.col(own["whole"]))
    times = F.col(own["whole"]) + F.when(place <= F.col(own["cut"]), 1).otherwise(0)
    joined = keyed.join(ends, same).withColumn(own["cut"], times).where(F.col(own["cut"]) > 0)
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(own["cut"]) - 1))
    return joined.select(*(F.col(f"`{c}`") for c in documents.columns), epochs.alias(result))
