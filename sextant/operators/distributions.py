"""Weighted distributions as tables, and picks from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import cumulative


def learn(rows: DataFrame, value: str, weight: Column | None = None, given: Sequence[str] = ()) -> DataFrame:
    """(given..., value, weight): an independent distribution, or one for each tuple of parents."""
    return rows.groupBy(*given, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("weight"))


def top_level(conditional: DataFrame, value: str) -> DataFrame:
    """The unconditional distribution of a conditional one."""
    return conditional.groupBy(value).agg(F.sum("weight").alias("weight"))


def remap(distribution: DataFrame, value: str, old: object, new: object) -> DataFrame:
    """The weight of ``old`` moved to ``new``."""
    others = [c for c in distribution.columns if c not in (value, "weight")]
    moved = distribution.withColumn(value, F.when(F.col(value) == F.lit(old), F.lit(new)).otherwise(F.col(value)))
    return moved.groupBy(*others, value).agg(F.sum("weight").alias("weight"))


def support(distribution: DataFrame, value: str) -> DataFrame:
    return distribution.select(value).distinct()


def size(distribution: DataFrame) -> DataFrame:
    return distribution.agg(F.sum("weight").alias("weight"))


def cdf(distribution: DataFrame, value: str, by_weight: bool = False) -> DataFrame:
    """Cumulative weights in order of the upper-cased value, or of the weight; ties by value."""
    key = F.upper(value) if dict(distribution.dtypes)[value] == "string" else F.col(value)
    ordered = distribution.withColumn("_key", key)
    order = ["weight", "_key", value] if by_weight else ["_key", value]
    return cumulative(ordered, order, "weight", "cum_weight").drop("_key")


def conditional_cdf(conditional: DataFrame, given: Sequence[str], value: str) -> DataFrame:
    order = Window.partitionBy(*given).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return conditional.withColumn("cum_weight", F.sum("weight").over(order)).withColumn("total", F.sum("weight").over(Window.partitionBy(*given)))


def forbidden(rows: DataFrame, columns: Sequence[str], characters: str = '|"') -> DataFrame:
    """(column, n_bad): values with a forbidden character, by column."""
    bad = [F.sum(F.when(F.length(F.translate(F.col(c).cast("string"), characters, "")) < F.length(F.col(c).cast("string")), 1).otherwise(0)).alias(c) for c in columns]
    counts = rows.agg(*bad)
    return counts.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", "n_bad"))


def in_share(cumulated: DataFrame, low: float, high: float) -> DataFrame:
    """Values whose own share of the rows lies in [low, high]."""
    share = F.col("weight") / F.col("total")
    return cumulated.where((share >= low) & (share <= high))


def upper_bounds(cumulated: DataFrame, low: float, high: float) -> DataFrame:
    """Values v such that the rows up to v are a share in [low, high]."""
    share = F.col("cum_weight") / F.col("total")
    return cumulated.where((share >= low) & (share <= high))


def lower_bounds(cumulated: DataFrame, low: float, high: float) -> DataFrame:
    """Values v such that the rows from v on are a share in [low, high]."""
    share = (F.col("total") - F.col("cum_weight") + F.col("weight")) / F.col("total")
    return cumulated.where((share >= low) & (share <= high))


def next_words(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(first, second, following, n): how often a word follows two others; sentence starts have empty words before."""
    rows = rows.select(tokens.alias("t")).where(F.size("t") > 0)
    rows = rows.select(F.concat(F.array(F.lit(""), F.lit("")), "t").alias("p"), F.size("t").alias("n"))
    beside = F.arrays_zip(*[F.slice("p", k, F.col("n")) for k in (1, 2, 3)])  # three shifted copies, side by side
    each = rows.select(F.inline(beside)).toDF("first", "second", "following")
    # three words as one text, after the lengths of two: fewer bytes in the shuffle and in memory than three texts
    whole = F.concat(F.length("first").cast("string"), F.lit(":"), F.length("second").cast("string"), F.lit(":"), "first", "second", "following")
    counts = each.groupBy(whole.alias("w")).agg(F.count("*").alias("n"))
    sizes = [F.substring_index(F.substring_index("w", ":", k), ":", -1).cast("int") for k in (1, 2)]
    start = F.length(F.substring_index("w", ":", 2)) + 2
    counts = counts.select("w", "n", sizes[0].alias("a"), sizes[1].alias("b"), start.alias("s"))
    return counts.select(F.substr("w", F.col("s"), F.col("a")).alias("first"), F.substr("w", F.col("s") + F.col("a"), F.col("b")).alias("second"), F.substr("w", F.col("s") + F.col("a") + F.col("b")).alias("following"), "n")
