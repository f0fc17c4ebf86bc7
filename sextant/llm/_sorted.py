"""Rows in one global order, read task by task with the neighbours of every task's edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import col, cut


def in_order(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with columns ``part`` and ``side`` in the order of ``keys``, and the table to discard after use.

    Ranges of the order are parts of about equal size. Tasks read whole parts,
    each in order: side 0 are its own rows, side -1 is the last row before it
    and side 1 the first row after it, whatever part they belong to. Rows with
    equal keys may lie on both sides of an edge, so a hot key is no hot part.
    All columns must be orderable; the rows of the edges are two a part.
    """
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    ranged = df.select(*map(col, columns)).repartitionByRange(*map(col, keys)).sortWithinPartitions(*map(col, keys))
    parts = cut(ranged.withColumn("part", F.spark_partition_id()))
    row = F.struct(*map(col, columns))
    ends = parts.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    order = Window.orderBy("part")  # one row a part
    ends = ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    own = parts.select("part", F.lit(0).alias("side"), *map(col, columns))
    for name, side in (("before", -1), ("after", 1)):
        own = own.union(ends.where(F.col(name).isNotNull()).select("part", F.lit(side), F.col(f"{name}.*")))
    return own.repartition("part").sortWithinPartitions("part", "side", *map(col, keys)), parts
