"""Aggregations of the search assessment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.predicates import words
from sextant.functions.scalars import micros, upper
from sextant.scratch import fresh, written


def value_counts(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy(field).agg(F.count("*").alias("n"))


def running(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """Rows up to each value and from it on, for ranges.

    Distinct values are ranged and summed within their range, with the totals of
    the ranges before it, so one task never holds all values.
    """
    total = fresh("total", counts.columns)
    return cumulative(counts, [value], n, "up_to", total=total).withColumn("n_from", F.col(total) - F.col("up_to") + F.col(n)).drop(total)


def cumulative(
    rows: DataFrame, order: Sequence[str], weight: str, name: str, *, total: str = "total", decimal: str | None = None, by: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """``name``: the running sum of ``weight`` in ``order`` within ``by``, and ``total``; nulls come first.

    Rows are dealt by ranges of (by, order) and written once with the number of
    their range; sums run within a range, and the ranges' totals run on their
    own, as many rows as ranges and one more for each group. Spark takes the
    bounds, as many as it has shuffle partitions (or ``parts``), and they stay in
    the shuffle. A group may span any number of ranges, and peers, rows equal in
    (by, order), share one.
    """
    part, before, summed, of = (fresh(c, [*rows.columns, name, total]) for c in ("_part", "_before", "_sum", "_of"))
    keys = [F.col(c) for c in (*by, *order)]
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    marked = written(ranged.withColumn(part, F.spark_partition_id()))
    w = F.col(weight).cast(decimal) if decimal else F.col(weight)
    totals = marked.groupBy(part, *by).agg(F.sum(w).alias(summed))
    series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = series.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = {k: f"{of}{i}" for i, k in enumerate((part, *by))}
    totals = totals.select(*[F.col(k).alias(n) for k, n in names.items()], F.coalesce(F.sum(summed).over(earlier), F.lit(0)).alias(before), F.sum(summed).over(whole).alias(total))
    same = F.lit(True)
    for k, n in names.items():
        same = same & marked[k].eqNullSafe(F.col(n))
    within = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum(w).over(within)).join(totals, same).withColumn(name, F.col(before) + F.col(name)).drop(part, before, *names.values())


def word_counts(rows: DataFrame, key: str, text: str, shown: Callable[[Column], Column] = upper) -> DataFrame:
    """Rows that contain each word in upper case, as ``shown`` makes it (``F.upper`` writes ``SS`` for ``ß``)."""
    return rows.select(F.explode(words(text, shown)).alias("word")).groupBy("word").agg(F.count("*").alias("n_rows"))


def capped_ids(matches: DataFrame, cap: int, query: str = "qid", key: str = "id") -> DataFrame:
    """(query, n, valid, ids): the sorted ids of each query, or none if there are more than ``cap``.

    The count comes first, so ids beyond the cap are never gathered.
    """
    counts = matches.groupBy(query).agg(F.count("*").alias("n"))
    small = matches.join(counts.where(F.col("n") <= cap).select(query), query, "left_semi")
    lists = small.groupBy(query).agg(F.sort_array(F.collect_list(key)).alias("ids"))
    return counts.join(lists, query, "left").select(query, "n", (F.col("n") <= cap).alias("valid"), F.coalesce("ids", F.array()).alias("ids"))


def fishing(matches: DataFrame, value: str, query: str = "qid", key: str = "id") -> DataFrame:
    """Of each query's matches those with its smallest value."""
    least = matches.groupBy(query).agg(F.min(value).alias("_least"))
    return matches.join(least, query).where(F.col(value) == F.col("_least")).select(query, key, value)


def by_distance(matches: DataFrame, query: str = "qid", distance: str = "distance") -> DataFrame:
    """Per query its distances in order with the rows at each."""
    return matches.groupBy(query, distance).agg(F.count("*").alias("n"))


def marginals(rows: DataFrame, fields: Sequence[str], weight: str) -> DataFrame:
    """The weighted contingency table over every subset of ``fields``."""
    return rows.cube(*fields).agg(F.sum(weight).alias("weight"), F.grouping_id().alias("level"))


def summary(rows: DataFrame, value: str, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Count, mean, population standard deviation, least and greatest, rounded."""
    r = lambda c, name: F.round(c, digits).alias(name)
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), r(F.avg(v), "mean"), r(F.stddev_pop(v), "std"), r(F.min(v), "least"), r(F.max(v), "greatest"))


def percentiles(rows: DataFrame, value: str, by: Sequence[str], points: Sequence[int] = tuple(range(1, 101))) -> DataFrame:
    """Exact nearest-rank percentiles: the value of rank (p n + 99) div 100.

    Values are counted first; ranks are running counts by ranges of the values, so
    no task sorts all values of a large group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    total = fresh("total", counts.columns)
    ranks = cumulative(counts, [value], "c", "up", total=total, by=by)
    asked = F.array(*[F.lit(p) for p in points])
    rank = lambda p: F.floor((p * F.col(total) + 99) / 100)
    hit = F.filter(asked, lambda p: (rank(p) <= F.col("up")) & (rank(p) > F.col("up") - F.col("c")))
    return ranks.select(*by, F.explode(hit).alias("p"), F.col(value).alias("value"))


def approximate(rows: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles from mergeable sketches; 0 and 1 give least and greatest."""
    inner = F.percentile_approx(value, [float(s) for s in shares], accuracy)
    fixed = [F.when(F.lit(s <= 0), F.min(value)).when(F.lit(s >= 1), F.max(value)).otherwise(F.get(inner, F.lit(i))).alias(f"q{i}") for i, s in enumerate(shares)]
    return rows.groupBy(*by).agg(*fixed)


def all_equal(c: str) -> Column:
    """The common value of a group, null if its values differ."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def rate(rows: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows per second between the first start and the last end (timestamps)."""
    seconds = (micros(F.max(end)) - micros(F.min(start))) / 1e6
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(seconds > 0, F.count("*") / seconds).alias("per_second"))
