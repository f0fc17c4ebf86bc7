"""Windowed computations over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.scalars import micros
from sextant.scratch import fresh


def neighbours(rows: DataFrame, by: Sequence[str], time: str, tie: str) -> DataFrame:
    """The previous and next time in each series; the series' own ends where there is none."""
    order = Window.partitionBy(*by).orderBy(time, tie)
    return rows.withColumn("previous", F.coalesce(F.lag(time).over(order), F.col(time))).withColumn("following", F.coalesce(F.lead(time).over(order), F.col(time)))


def gap_sessions(rows: DataFrame, by: Sequence[str], time: str, gap: float, sums: dict[str, Column]) -> DataFrame:
    """Bursts: a new one begins where the gap to the last row is ``gap`` seconds or more."""
    order = Window.partitionBy(*by).orderBy(time)
    step = micros(time) - micros(F.lag(time).over(order))
    flagged = rows.withColumn("_new", F.when(step >= int(gap * 1e6), 1).otherwise(0))
    numbered = flagged.withColumn("session", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), *[c.alias(k) for k, c in sums.items()])


def clock(rows: DataFrame, by: Sequence[str], line: str, local: str, sync: str) -> DataFrame:
    """Local times mapped by the most recent sync (``sync`` is the true time on sync rows, else null).

    ``true_time``; ``drift`` at each sync against the one before; ``backwards``
    where a local time is earlier than the line before. Lines before the first
    sync use the first.
    """
    order = Window.partitionBy(*by).orderBy(line)
    up_to, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col(sync).isNotNull(), F.struct(F.col(sync).alias("s"), F.col(local).alias("l")))
    rows = rows.withColumn("_m", mark)
    rows = rows.withColumn("_at", F.coalesce(F.last("_m", True).over(up_to), F.first("_m", True).over(after)))
    before = F.last("_m", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    drift = F.when(F.col(sync).isNotNull(), (F.col(sync) - before["s"]) - (F.col(local) - before["l"]))
    return rows.select("*", (F.col("_at.s") + F.col(local) - F.col("_at.l")).alias("true_time"), drift.alias("drift"), F.coalesce(F.col(local) < F.lag(local).over(order), F.lit(False)).alias("backwards")).drop("_m", "_at")


def bins(rows: DataFrame, time: str, width: int, by: Sequence[str], value: str, name: str = "total", decimal: str = "decimal(18,2)") -> DataFrame:
    """Sums in equal bins of ``width`` seconds from a series' first row to its last; empty bins have 0."""
    at = F.floor(micros(time) / (width * 1_000_000))
    sums = rows.groupBy(*by, at.alias("bin")).agg(F.sum(F.col(value).cast(decimal)).alias(name))
    spine = sums.groupBy(*by).agg(F.min("bin").alias("_a"), F.max("bin").alias("_b")).select(*by, F.explode(F.sequence("_a", "_b")).alias("bin"))
    return spine.join(sums, [*by, "bin"], "left").select(*by, "bin", F.coalesce(name, F.lit(0)).cast("double").alias(name))


def tiers(ids: str, sizes: str, key: str, rows: DataFrame) -> DataFrame:
    """(key, tier, id): a ranked list cut into consecutive tiers of the given sizes; the rest is the last tier.

    ``sizes`` is a short array; its running sums place each position.
    """
    ends = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    cut = rows.select(key, ends.alias("_ends"), F.posexplode(ids).alias("_pos", "id"))
    return cut.select(key, F.size(F.filter("_ends", lambda e: e <= F.col("_pos"))).alias("tier"), "id")


def elapsed(rows: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Seconds since each series' first row."""
    first = rows.groupBy(*by).agg(F.min(time).alias("_first"))
    return rows.join(first, list(by)).withColumn("elapsed", (micros(time) - micros("_first")) / 1e6).drop("_first")


def every_nth(rows: DataFrame, key: str, count: str, limit: int, n: int = 5) -> DataFrame:
    """``star``: true for every ``n``-th row, in order of ``key``, of those with a count under ``limit``."""
    from .aggregates import cumulative

    one, at, total = (fresh(c, rows.columns) for c in ("_one", "_at", "total"))
    marked = rows.withColumn(one, F.when(F.col(count) < limit, 1).otherwise(0))
    return cumulative(marked, [key], one, at, total=total).withColumn("star", (F.col(one) == 1) & (F.col(at) % n == 0)).drop(one, at, total)
