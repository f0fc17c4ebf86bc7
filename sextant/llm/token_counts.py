"""Token counts from an exact length histogram.

Documents are aggregated by encoded length once. Suffix sums over the lengths
then answer, for any context limit, how many documents are longer, how many
tokens there are in all, and how many are left when every document is cut at
the limit; running counts answer quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from ._shared import cut, table

#: Lengths per block of the two-level sums.
BLOCK = 1024


def histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``length``, ``n_docs``: documents by encoded length; a null or empty text has length 0.

    Partial counts are made before the shuffle, so a task sends one row for
    each of its lengths. Repeated rows count as often as they stand there.
    """
    return bpe.encode(docs, text, (), vocabulary, ids=False).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def sums(hist: DataFrame) -> DataFrame:
    """The histogram with its running and suffix sums, one row for each length that occurs.

    ``docs_up_to``, ``docs_longer``, ``tokens_up_to``, ``tokens_longer`` (of
    documents longer than the length) and ``tokens_cut`` (all tokens when every
    document is cut at the length), ``rank`` (the share of documents up to it).
    Sums go within blocks of lengths and over the blocks' totals, so no task
    needs the whole histogram; blocks are as many as the longest text over BLOCK.
    An empty histogram gives no rows.
    """
    hist = cut(hist)  # it is read twice, and is as long as there are lengths
    blocked = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (
        blocked.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"],
            *[F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"],
        )
    )
    within = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(blocks, "block").select(
        "length", "n_docs", "tokens", "d_all", "t_all",
        (F.col("d_before") + F.sum("n_docs").over(within)).alias("docs_up_to"),
        (F.col("t_before") + F.sum("tokens").over(within)).alias("tokens_up_to"),
    )
    longer = F.col("d_all") - F.col("docs_up_to")
    return out.select(
        "length", "n_docs", "tokens", "docs_up_to", longer.alias("docs_longer"), "tokens_up_to",
        (F.col("t_all") - F.col("tokens_up_to")).alias("tokens_longer"),
        (F.col("tokens_up_to") + longer * F.col("length")).alias("tokens_cut"),
        (F.col("docs_up_to") / F.col("d_all")).alias("rank"),
    )


def at_limits(summed: DataFrame, limits: DataFrame, limit: str = "limit") -> DataFrame:
    """For each context limit: documents longer than it, and the tokens left when cut there.

    The answer for a limit between two lengths comes from the next lower one.
    Limits and lengths are ordered together by block, so none is compared with all.
    """
    first = summed.agg(F.max(F.col("docs_up_to") + F.col("docs_longer")).alias("d")).select(F.coalesce("d", F.lit(0)).alias("d"))
    marks = summed.select(F.col("length").alias("at"), F.struct("docs_longer", "tokens_up_to").alias("s"), F.lit(None).cast("long").alias("limit"))
    asked = limits.select(F.col(limit).cast("long").alias("at"), F.lit(None).cast(marks.schema["s"].dataType).alias("s"), F.col(limit).cast("long").alias("limit")).where("at is not null").distinct()
    rows = marks.unionByName(asked).withColumn("block", F.floor(F.col("at") / BLOCK))
    ends = rows.groupBy("block").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("at"))).alias("end"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("block", F.last("end", True).over(earlier).alias("end"))
    within = Window.partitionBy("block").orderBy("at", F.col("limit").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(ends, "block").withColumn("s", F.coalesce(F.last("s", True).over(within), "end")).where("limit is not null")
    longer = F.coalesce(F.col("s.docs_longer"), F.col("d"))
    return found.crossJoin(F.broadcast(first)).select(  # one row
        F.col("limit"), longer.alias("docs_longer"), (F.coalesce(F.col("s.tokens_up_to"), F.lit(0)) + longer * F.col("limit")).alias("tokens_cut")
    )


def quantile(summed: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents reach or stay under."""
    return summed.where(F.col("rank") >= share).agg(F.min("length").alias("length"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its sums."""
    return sums(histogram(table(spark, sf_dir, "documents")))


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
