"""Queries of several terms whose results have a wanted size: conjunctions and unions of any number of terms.

``matches`` (qid, id) are the rows of each term, ``terms`` (qid, field) say which
terms exclude each other, those of one field. Rows that meet the same terms are
one pattern with a count, so the search works on patterns, of which there are
far fewer than rows. Each level of the search is one grouped pass over
(pattern, set of terms) and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.scratch import written

from .workload import counted


def _items(matches: DataFrame, sized: DataFrame) -> DataFrame:
    """(pattern, n, items): the sets of terms that rows meet, items (key, qid, field, c) in order of key, and their rows."""
    item = F.struct("key", "qid", "field", "c")
    met = matches.distinct().join(sized, "qid").groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return met.groupBy("items").agg(F.count("*").alias("n")).select(F.md5(F.array_join(F.transform("items", lambda x: x["qid"].cast("string")), ",")).alias("pattern"), "n", "items")


def _further(state: DataFrame) -> DataFrame:
    """Each set with one more item of its pattern, on a field that the set has not, after its last item."""
    after = F.filter("items", lambda x: (x["key"] > F.element_at("set", -1)["key"]) & ~F.exists("set", lambda s: s["field"] == x["field"]))
    return state.select("pattern", "n", "items", F.col("set").alias("had"), F.explode(after).alias("x")).select("pattern", "n", "items", F.concat("had", F.array("x")).alias("set"))


def conjunctions(matches: DataFrame, terms: DataFrame, n: int, low: int, high: int, first_low: int = 0, first_high: int = (1 << 62)) -> DataFrame:
    """(terms, first, n_first, n): sets of ``n`` terms on distinct fields with ``low`` to ``high`` (low >= 1) rows in common.

    ``first`` is the term that a query would try first: of those with
    ``first_low`` to ``first_high`` rows the one with fewest, the smallest qid
    among equals; sets without one are left out. Sets of k + 1 terms grow only
    from sets of k terms with ``low`` rows at least, and terms of the first
    band come first in every set, so the band prunes from the start.
    """
    if low < 1:
        raise ValueError("sets without common rows are without number: low is at least 1")
    band = F.col("c").between(first_low, first_high)
    sized = counted(matches.distinct()).withColumnRenamed("n", "c").join(terms.select("qid", "field").distinct(), "qid").where(F.col("c") >= low)
    sized = sized.select("qid", "field", "c", F.struct((~band).alias("later"), "c", "qid").alias("key"))
    state = written(_items(matches, sized)).select("pattern", "n", "items", F.explode(F.filter("items", lambda x: ~x["key"]["later"])).alias("x")).select("pattern", "n", "items", F.array("x").alias("set"))
    for _ in range(n - 1):
        state = written(_further(state))
        frequent = state.groupBy("set").agg(F.sum("n").alias("rows")).where(F.col("rows") >= low).select("set")
        state = state.join(frequent, "set", "left_semi").select("pattern", "n", "items", "set")
    found = state.groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n").between(low, high))
    return found.select(F.transform("set", lambda x: x["qid"]).alias("terms"), F.col("set")[0]["qid"].alias("first"), F.col("set")[0]["c"].alias("n_first"), "n")


def _bucket(c: Column) -> Column:
    """The number of bits of a count: counts of a range meet in a few buckets."""
    return F.length(F.bin(c))


def unions(matches: DataFrame, terms: DataFrame, n: int, low: int, high: int, sum_low: int = 0, sum_high: int = (1 << 62)) -> DataFrame:
    """(terms, n_sum, n): sets of ``n`` terms on distinct fields whose union has ``low`` to ``high`` rows and whose
    counts add up to ``sum_low`` to ``sum_high``.

    A set takes a further term on another field only while neither its union
    nor its sum exceeds its band, and the last term must lift both into it; the
    two meet in buckets of counts by an equi-join. What a term adds is its count
    less the patterns that it shares with the set, from one grouped pass.
    """
    sized = counted(matches.distinct()).withColumnRenamed("n", "c").join(terms.select("qid", "field").distinct(), "qid").select("qid", "field", "c", F.col("qid").alias("key"))
    patterns = written(_items(matches, sized)).select("pattern", "n", F.explode("items").alias("x")).select("pattern", "n", "x.qid")
    fits = (F.col("c") <= high) & (F.col("c") <= sum_high)
    sets = sized.where(fits).select(F.array("qid").alias("set"), F.array("field").alias("fields"), F.col("c").alias("total"), F.col("c").alias("either"))
    held = patterns.select(F.array("qid").alias("set"), "pattern", "n")
    for k in range(2, n + 1):
        last = k == n
        need = F.greatest(F.lit(1), F.lit(low) - F.col("either"), F.lit(sum_low) - F.col("total")) if last else F.lit(1)
        room = F.least(F.lit(high), F.lit(sum_high) - F.col("total"))
        spans = sets.select("*", need.cast("long").alias("need"), room.cast("long").alias("room")).where("need <= room").withColumn("bucket", F.explode(F.sequence(_bucket(F.col("need")), _bucket(F.col("room")))))
        met = spans.join(sized.withColumn("bucket", _bucket(F.col("c"))), "bucket").where((F.col("c") >= F.col("need")) & (F.col("c") <= F.col("room")) & (F.col("qid") > F.element_at("set", -1)) & ~F.array_contains("fields", F.col("field")))
        overlap = held.join(patterns.select("pattern", "qid"), "pattern").groupBy("set", "qid").agg(F.sum("n").alias("overlap"))
        grown = met.join(overlap, ["set", "qid"], "left").withColumn("either_", F.col("either") + F.col("c") - F.coalesce("overlap", F.lit(0)))
        grown = grown.where((F.col("either_") <= high) & ((F.col("either_") >= low) & (F.col("total") + F.col("c") >= sum_low) if last else F.lit(True)))
        grown = written(grown.select(F.concat("set", F.array("qid")).alias("set"), F.concat("fields", F.array("field")).alias("fields"), (F.col("total") + F.col("c")).alias("total"), F.col("either_").alias("either"), F.col("set").alias("from"), "qid"))
        sets = grown.select("set", "fields", "total", "either")
        if not last:
            more = grown.select("set", "from").join(held.withColumnRenamed("set", "from"), "from").select("set", "pattern", "n")
            held = written(more.union(grown.select("set", "qid").join(patterns, "qid").select("set", "pattern", "n")).distinct())
    return sets.where(F.col("either").between(low, high) & F.col("total").between(sum_low, sum_high)).select(F.col("set").alias("terms"), F.col("total").alias("n_sum"), F.col("either").alias("n"))


def texts(found: DataFrame, matches: DataFrame, where: DataFrame, word: str = "AND") -> DataFrame:
    """``found`` with ``cid`` and ``where_clause``: the terms' texts (qid, where) in the order in which they leave fewest rows, the first one first."""
    from .workload import reorder

    named = found.withColumn("cid", F.xxhash64(F.array_join(F.transform("terms", lambda x: x.cast("string")), ",")))
    first = F.col("first") if "first" in found.columns else F.lit(None).cast("long")
    combos = named.select("cid", F.explode("terms").alias("qid"), first.alias("_first")).select("cid", "qid", F.coalesce(F.col("qid") == F.col("_first"), F.lit(False)).alias("first"))
    parts = reorder(combos, matches, "first").join(where.select("qid", "where"), "qid")
    clause = parts.groupBy("cid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "where"))), lambda x: x["where"]), f" {word} ").alias("where_clause"))
    return named.join(clause, "cid")
