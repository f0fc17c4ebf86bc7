"""Scores of returned results against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import compare, within
from .windows import tiers


def precision(tp: Column, fp: Column) -> Column:
    """To three places; 1 when nothing was returned."""
    return F.when(tp + fp == 0, 1.0).otherwise(F.round(tp / (tp + fp), 3))


recall = precision


def bad_fraction(bad: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.round(bad / n, 3))


def score(truth: DataFrame, returned: DataFrame, query: str = "qid", key: str = "id", payload: str | None = "hash") -> DataFrame:
    """Per query: tp, fp, fn, bad_hash and whether it is wrong; long tables on both sides.

    Rows are compared by (query, id) in one full join, so no list is gathered.
    """
    pay = [payload] if payload else []
    a = truth.select(query, key, F.lit(True).alias("t"), *[F.col(p).alias("th") for p in pay])
    b = returned.select(query, key, F.lit(True).alias("r"), *[F.col(p).alias("rh") for p in pay])
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    t, r = F.col("t").isNotNull(), F.col("r").isNotNull()
    bad = t & r & ~F.col("th").eqNullSafe(F.col("rh")) if payload else F.lit(False)
    out = a.join(b, [query, key], "full_outer").groupBy(query).agg(n(t & r, "tp"), n(~t & r, "fp"), n(t & ~r, "fn"), n(bad, "bad_hash"))
    return out.withColumn("wrong", (F.col("fp") > 0) | (F.col("fn") > 0) | (F.col("bad_hash") > 0))


def rates(scored: DataFrame) -> DataFrame:
    tp, fp, fn, bad = (F.col(c) for c in ("tp", "fp", "fn", "bad_hash"))
    return scored.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "bad_hash_fraction": bad_fraction(bad, tp)})


def badly_ranked(truth: DataFrame, returned: DataFrame, query: str = "qid") -> DataFrame:
    """Queries whose returned list differs from the truth in some tier.

    ``truth`` has ids and tier sizes, ``returned`` the returned ids; tiers are
    compared as sets of (tier, id).
    """
    a = tiers("ids", "sizes", query, truth)
    b = tiers("ids", "sizes", query, returned.join(truth.select(query, "sizes"), query))
    off = compare(a, b, [query, "tier", "id"], ["tier"]).where("status != 'equal'").select(query).distinct()
    return truth.select(query).join(off.withColumn("_off", F.lit(True)), query, "left").select(query, F.coalesce("_off", F.lit(False)).alias("badly_ranked"))


def policy(rows: DataFrame) -> DataFrame:
    """Confusion counts of policy rejections; rows need ``returned`` and ``matching`` (numbers), ``current`` and ``rejecting`` (arrays).

    Rows without matches or without a current policy are left out.
    """
    rejected, should = F.col("returned") == 0, F.arrays_overlap("current", "rejecting")
    kept = rows.where((F.col("matching") > 0) & (F.size("current") > 0))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return kept.agg(n(rejected & should, "right_reject"), n(~rejected & ~should, "right_accept"), n(rejected & ~should, "wrong_reject"), n(~rejected & should, "wrong_accept"))


def merged(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added scores for every subset of ``keys``; a null key with its bit set in ``level`` stands for all."""
    return rates(scored.cube(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "bad_hash")], F.grouping_id().alias("level")))


def freshness(mods: DataFrame, queries: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Queries sent between a modification's neighbours, told whether they show it.

    ``mods``: mid, category, previous, at, following (seconds), pre and post (id lists);
    ``queries``: qid, sent, ids; both have the columns of ``by``, the series that a
    modification's neighbours and its queries come from. A query before the
    modification should show ``pre``, one after it ``post``.
    """
    near = within(queries, mods.select("mid", "category", "previous", "at", "following", "pre", "post", *by), "sent", "previous", "following", width, by)
    after = F.col("sent") >= F.col("at")
    expected = F.when(after, F.col("post")).otherwise(F.col("pre"))
    verdict = F.when(F.col("ids") == expected, "good").when(after & (F.col("ids") == F.col("pre")), "stale").otherwise("bad")
    return near.withColumn("verdict", verdict).withColumn("delay", F.col("sent") - F.col("at"))


def arrival(fresh: DataFrame) -> DataFrame:
    """Per category the earliest right and the latest stale answer after the modification."""
    late = F.col("delay") >= 0
    return fresh.groupBy("category").agg(F.min(F.when(late & (F.col("verdict") == "good"), F.col("delay"))).alias("first_good"), F.max(F.when(late & (F.col("verdict") == "stale"), F.col("delay"))).alias("last_stale"))


def support_matrix(rows: DataFrame, keys: Sequence[str], kind: str, correct: str, kinds: Sequence[str]) -> DataFrame:
    """Per key and field type ``pass`` if any answer was right, else ``fail``; ``-`` where none was asked."""
    verdict = rows.groupBy(*keys).pivot(kind, list(kinds)).agg(F.when(F.max(F.col(correct).cast("int")) == 1, "pass").otherwise("fail"))
    return verdict.select(*keys, *[F.coalesce(F.col(f"`{k}`"), F.lit("-")).alias(k) for k in kinds])


def new_records(matching: Column, events: Column, cached: str = "99") -> Column:
    """Matching records less the events that tell of a cached one."""
    return matching - F.size(F.filter(events, lambda e: e == cached))


def accuracy(rows: DataFrame, by: Sequence[str], correct: str, failed: str) -> DataFrame:
    """The share of right evaluations, without failed ones."""
    good = rows.where(~F.col(failed))
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("int")), 6).alias("accuracy"))
