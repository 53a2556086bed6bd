"""Positions within groups that may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.operators.stages import written


def grouped_positions(df: DataFrame, keys: list[str], order: list[str], unique_id: str, name: str = "position") -> DataFrame:
    """1-based position of each row in its group, ordered by ``order`` then ``unique_id``.

    Missing values come first, and rows with missing keys are groups of their own. A plain
    ``row_number`` would sort a whole group in one task. Here the rows are range-partitioned
    by all the columns, so a large group is spread over many partitions, however many
    different values the order has; rows are numbered within partition and group, and shifted
    by what the group has in earlier partitions: one row per partition and group. The
    partitioned rows are a table, as another run of the sampling might cut them elsewhere.
    """
    part = "__part"
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order, unique_id)])
    table = written(ranged.withColumn(part, F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.groupBy(*keys, part).agg(F.count("*").alias("__rows")).select(
        *[F.col(c).alias(f"__{c}") for c in keys], F.col(part).alias("__in"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"),
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], F.col(part) == F.col("__in"))
    within = Window.partitionBy(*keys, part).orderBy(*[F.col(c).asc_nulls_first() for c in (*order, unique_id)])
    numbered = table.withColumn(name, F.row_number().over(within))
    return numbered.join(offsets, same).select(*df.columns, (F.col(name) + F.col("__offset")).alias(name))
