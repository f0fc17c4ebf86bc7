"""Performance: percentile criteria, regressions, throughput, choices of a database."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import percentiles


def both_percentiles(candidate: DataFrame, baseline: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., p, cand, base): all 100 percentiles of each side over their common keys."""
    a = percentiles(candidate.join(baseline, [*by, key], "left_semi"), value, by).withColumnRenamed("value", "cand")
    b = percentiles(baseline.join(candidate, [*by, key], "left_semi"), value, by).withColumnRenamed("value", "base")
    return a.join(b, [*by, "p"])


def met(cand: Column, base: Column, a: float, b: float) -> Column:
    """cand <= a + b * base."""
    return cand <= F.lit(a) + F.lit(b) * base


def ratio_met(cand: Column, base: Column, ratio: float) -> Column:
    return cand <= F.lit(ratio) * base


def grid(points: DataFrame, by: Sequence[str] = (), a_max: int = 15, b_max: int = 10) -> DataFrame:
    """For a = 0..a_max and b = 1..b_max: how many percentiles meet the criterion, the least and the greatest one."""
    ab = F.explode(F.sequence(F.lit(0), F.lit(a_max)))
    rows = points.withColumn("a", ab).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b_max))))
    good = F.col("cand") <= F.col("a") + F.col("b") * F.col("base")
    out = rows.groupBy(*by, "a", "b").agg(F.count(F.when(good, 1)).alias("n_met"), F.min(F.when(good, F.col("p"))).alias("least_met"), F.max(F.when(good, F.col("p"))).alias("greatest_met"))
    return out.withColumn("colour", F.when(F.col("n_met") == 100, "green").when(F.col("n_met") > 0, "yellow").otherwise("red"))


def holds(points: DataFrame, criterion: Callable[[Column, Column], Column], by: Sequence[str] = ()) -> DataFrame:
    """Whether a criterion over (cand, base) holds at every percentile."""
    return points.groupBy(*by).agg(F.bool_and(criterion(F.col("cand"), F.col("base"))).alias("holds"))


def tenfold(cand: Column, base: Column) -> Column:
    """cand <= 10 * base + 15."""
    return met(cand, base, 15, 10)


def ratios(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(F.avg(F.col("cand") / F.col("base")).alias("mean_ratio"))


def line(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per group with R squared; null with under 3 rows, one x or one y only."""
    usable = (F.count("*") >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = lambda c, name: F.when(usable, F.round(c, 6)).alias(name)
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), r(F.regr_slope(y, x), "slope"), r(F.regr_intercept(y, x), "intercept"), F.when(usable, F.round(F.regr_r2(y, x), 3)).alias("r2"))


def plane(rows: DataFrame, inputs: Sequence[Column], y: Column) -> tuple[list[float], float] | None:
    """(coefficients, the constant last; R squared) on up to a few inputs, from one pass of summed products.

    None with too few rows, a single output or an input without spread.
    """
    import numpy as np

    xs = [*inputs, F.lit(1.0)]
    k = len(xs)
    named = {f"x{i}_{j}": F.sum(xs[i] * xs[j]) for i in range(k) for j in range(i, k)} | {f"y{i}": F.sum(xs[i] * y) for i in range(k)} | {"yy": F.sum(y * y), "least": F.min(y), "most": F.max(y)}
    s = rows.agg(*[c.cast("double").alias(n) for n, c in named.items()]).first()
    n = s[f"x{k - 1}_{k - 1}"] or 0
    if n < k + 1 or s["least"] == s["most"]:
        return None
    a = np.array([[s[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    if np.linalg.matrix_rank(a) < k:
        return None
    b = np.array([s[f"y{i}"] for i in range(k)])
    c = np.linalg.solve(a, b)
    mean = b[-1] / n
    explained = float(c @ a @ c) - 2 * mean * float(c @ a[-1]) + n * mean**2
    return c.tolist(), round(explained / (s["yy"] - n * mean**2), 3)


def main_database(rows: DataFrame, name: str, records: str, size: str, preferred: Sequence[tuple[int, int]]) -> DataFrame:
    """The first preferred (records, size) that is present, else the most records, then the largest size."""
    rank = F.lit(len(preferred))
    for i, (n, s) in reversed(list(enumerate(preferred))):
        rank = F.when((F.col(records) == n) & (F.col(size) == s), i).otherwise(rank)
    return rows.select(name, records, size).distinct().orderBy(rank, F.desc(records), F.desc(size), name).limit(1)


def warnings(rows: DataFrame, latency: str, limit: float) -> DataFrame:
    return rows.where(F.col(latency) > limit)


def nearest_timing(queries: DataFrame, timings: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Each query with the timing of the smallest listed size that is not smaller than its own, else the largest.

    ``timings`` has fixed and per_match for keys and size: a small table, one row a configuration.
    """
    order = Window.partitionBy(*keys).orderBy(size)
    spans = timings.withColumn("_low", F.coalesce(F.lag(size).over(order), F.lit(-1))).withColumn("_high", F.when(F.lead(size).over(order).isNull(), F.lit(1 << 62)).otherwise(F.col(size)))
    spans = spans.drop(size)
    return queries.join(spans, list(keys)).where((F.col(size) > F.col("_low")) & (F.col(size) <= F.col("_high"))).drop("_low", "_high")
