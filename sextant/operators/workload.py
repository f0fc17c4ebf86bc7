"""Query workloads: candidates, evaluation of many queries in one pass, refinement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.predicates import words
from sextant.functions.scalars import upper

from .aggregates import cumulative


def cells(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(id, field, value): the rows in long form, values as upper-case text."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.upper(F.col(f).cast("string")).alias("value")) for f in fields])
    return rows.select(F.col(key).alias("id"), F.explode(listed).alias("c")).select("id", "c.field", "c.value")


def evaluate_equal(rows: DataFrame, queries: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(qid, id) for all equality queries (qid, field, value) at once, by one equi-join."""
    return cells(rows, key, fields).join(queries.select("qid", "field", F.upper("value").alias("value")), ["field", "value"]).select("qid", "id")


def evaluate_words(rows: DataFrame, queries: DataFrame, key: str, column: str) -> DataFrame:
    """(qid, id) for all keyword queries (qid, value) at once, by a join on the words."""
    index = rows.select(F.col(key).alias("id"), F.explode(words(column)).alias("word"))
    return index.join(queries.select("qid", upper(F.col("value")).alias("word")), "word").select("qid", "id")


def evaluate_ranges(rows: DataFrame, queries: DataFrame, key: str, field: str, width: float) -> DataFrame:
    """(qid, id) for all range queries (qid, low, high) on a number: rows meet ranges in buckets of ``width``.

    A bucket wholly inside a range needs no comparison, but joins like the rest.
    """
    touched = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    spans = queries.select("qid", "low", "high", touched.alias("bucket"))
    at = rows.select(F.col(key).alias("id"), F.col(field).alias("v"), F.floor(F.col(field) / width).alias("bucket"))
    return at.join(spans, "bucket").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select("qid", "id")


def evaluate_scan(rows: DataFrame, predicates: Sequence[tuple[int, Column]], key: str) -> DataFrame:
    """(qid, id) for a few dozen predicates of any kind, by one scan that tests them all."""
    hits = F.filter(F.array(*[F.when(p, F.lit(q)) for q, p in predicates]), lambda q: q.isNotNull())
    return rows.select(F.col(key).alias("id"), F.explode(hits).alias("qid")).select("qid", "id")


def counted(matches: DataFrame) -> DataFrame:
    return matches.groupBy("qid").agg(F.count("*").alias("n"))


def refine(queries: DataFrame, matches: DataFrame, per_query: bool = False) -> DataFrame:
    """Queries (qid, category, lower, upper) whose count lies in the band of their category, or their own."""
    sized = queries.join(counted(matches), "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if per_query:
        return sized.where((F.col("n") >= F.col("lower")) & (F.col("n") <= F.col("upper")))
    bands = queries.groupBy("category").agg(F.min("lower").alias("_l"), F.max("upper").alias("_u"))
    return sized.join(bands, "category").where((F.col("n") >= F.col("_l")) & (F.col("n") <= F.col("_u"))).drop("_l", "_u")


def one_each(refined: DataFrame, group: str, key: str = "qid") -> DataFrame:
    """One query of each group, the one with the smallest key."""
    return refined.join(refined.groupBy(group).agg(F.min(key).alias(key)), [group, key], "left_semi")


def pairs(matches: DataFrame, terms: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b, n_a, n_b, both): pairs of terms on distinct fields whose common rows number ``low`` to ``high``.

    ``terms``: qid, field; terms whose own count is under ``low`` leave first, then
    postings meet on the row, so only pairs with a common row arise.
    """
    sizes = counted(matches)
    large = matches.join(sizes.where(F.col("n") >= low), "qid").join(terms, "qid")
    a = large.select(F.col("qid").alias("a"), F.col("field").alias("fa"), F.col("n").alias("n_a"), "id")
    b = large.select(F.col("qid").alias("b"), F.col("field").alias("fb"), F.col("n").alias("n_b"), "id")
    met = a.join(b, "id").where((F.col("a") < F.col("b")) & (F.col("fa") != F.col("fb")))
    return met.groupBy("a", "b").agg(F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"), F.count("*").alias("both")).where((F.col("both") >= low) & (F.col("both") <= high))


def unions(matches: DataFrame, terms: DataFrame, low: int, high: int) -> DataFrame:
    """(a, b, n_a, n_b, either): pairs of terms on distinct fields whose union has ``low`` to ``high`` rows."""
    sizes = terms.join(counted(matches), "qid")
    a = sizes.select(F.col("qid").alias("a"), F.col("field").alias("fa"), F.col("n").alias("n_a"))
    b = sizes.select(F.col("qid").alias("b"), F.col("field").alias("fb"), F.col("n").alias("n_b"))
    # candidate terms, a bounded workload, meet by count: the union is at most the sum and at least the larger
    small = a.where(F.col("n_a") <= high).join(b.where(F.col("n_b") <= high), (F.col("a") < F.col("b")) & (F.col("fa") != F.col("fb")) & (F.col("n_a") + F.col("n_b") >= low))
    met = pairs(matches, terms, 1, 1 << 62).select("a", "b", "both")
    out = small.join(met, ["a", "b"], "left").withColumn("either", F.col("n_a") + F.col("n_b") - F.coalesce("both", F.lit(0)))
    return out.where((F.col("either") >= low) & (F.col("either") <= high)).select("a", "b", "n_a", "n_b", "either")


def thresholds(combos: DataFrame, matches: DataFrame) -> DataFrame:
    """(cid, matched, n): for each combination how many rows meet exactly so many of its terms, at least ``m``.

    ``combos``: cid, m, qid, one row a term. Rows that meet the same terms are
    counted first, so a few terms that most rows meet are not joined row by row.
    """
    patterns = matches.groupBy("id").agg(F.sort_array(F.collect_list("qid")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("rows"))
    terms = patterns.select("pattern", "rows", F.explode("pattern").alias("qid"))
    met = combos.join(terms, "qid").groupBy("cid", "pattern", "rows").agg(F.count("*").alias("matched"), F.min("m").alias("m"))
    return met.where(F.col("matched") >= F.col("m")).groupBy("cid", "matched").agg(F.sum("rows").alias("n"))


def reorder(combos: DataFrame, matches: DataFrame, first: str | None = None) -> DataFrame:
    """(cid, pos, qid): terms in greedy order, the smallest first, then the one that leaves fewest rows.

    Where the boolean column ``first`` marks a combination's term, that one
    stands first. Works on the counts of each subset of a combination's terms,
    which Spark aggregates; only these counts, at most 2^n for n terms, meet in a group.
    """
    joined = combos.join(matches, "qid").groupBy("cid", "id").agg(F.sort_array(F.collect_set("qid")).alias("terms"))
    patterns = joined.groupBy("cid", "terms").agg(F.count("*").alias("n"))
    marked = F.max(F.when(F.col(first), F.col("qid"))) if first else F.lit(None).cast("long")
    whole = combos.groupBy("cid").agg(F.sort_array(F.collect_set("qid")).alias("all"), marked.alias("first"))

    def order(group: pa.Table) -> pa.Table:
        cid, left, start = group.column("cid")[0].as_py(), list(group.column("all")[0].as_py()), group.column("first")[0].as_py()
        rows = [(set(t or ()), n or 0) for t, n in zip(group.column("terms").to_pylist(), group.column("n").to_pylist(), strict=True)]
        chosen: list[int] = [] if start is None else [start]
        left = [q for q in left if q != start]
        while left:
            best = min(left, key=lambda q: (sum(n for t, n in rows if t.issuperset([*chosen, q])), q))
            chosen.append(best)
            left.remove(best)
        return pa.table({"cid": [cid] * len(chosen), "pos": pa.array(range(len(chosen)), pa.int32()), "qid": chosen})

    return whole.join(patterns, "cid", "left").groupBy("cid").applyInArrow(order, "cid long, pos int, qid long")


def junction(full: DataFrame, key: str = "qid", terms: str = "terms") -> DataFrame:
    """(atomic_row_id, full_row_id), each once, from full queries with an array of term ids."""
    return full.select(F.explode(terms).alias("atomic_row_id"), F.col(key).alias("full_row_id")).distinct()


def junction_from_text(full: DataFrame, atomic: DataFrame, where: str = "where_clause") -> DataFrame:
    """The junction rebuilt from WHERE texts joined by AND or OR."""
    parts = F.split(F.regexp_replace(F.col(where), r"^\(|\)$", ""), r" (?:AND|OR) ")
    cut = full.select(F.col("qid").alias("full_row_id"), F.explode(parts).alias("w")).select("full_row_id", F.trim("w").alias("w"))
    return cut.join(atomic.select(F.col("aqid").alias("atomic_row_id"), F.trim(F.col(where)).alias("w")), "w").select("atomic_row_id", "full_row_id").distinct()


def select_components(full: DataFrame, links: DataFrame, category: str, low: int, high: int) -> DataFrame:
    """Component queries of a category with a count in the band that are not their own full query."""
    rows = full.where((F.col("category") == category) & F.col("n").between(low, high))
    return rows.join(links.where("atomic_row_id != full_row_id"), rows["qid"] == links["atomic_row_id"]).select("qid").distinct()


def cost(queries: DataFrame) -> DataFrame:
    """Seconds = fixed + per_match x (matches of the kind that ``basis`` names)."""
    amount = F.when(F.col("basis") == "total", F.col("n")).when(F.col("basis") == "first", F.col("n_first")).otherwise(F.col("n_last_tier"))
    return queries.withColumn("seconds", F.col("fixed") + F.col("per_match") * amount)


def pack(queries: DataFrame, by: Sequence[str], limit: float) -> DataFrame:
    """(by..., band, qid, batch): batches of at most ``limit`` seconds in order of qid, a new count in each band.

    A batch starts where the last one is full, which depends on all before it in
    its band; so a band's rows stream through a task in order, and only the
    running total and the batch's number are held.
    """
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    keys = [*by, "band"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, total, first = None, 0, 0.0, True
        for rows in batches:
            out = []
            columns = [rows.column(i).to_pylist() for i in range(len(keys) + 2)]
            for *group, _, seconds in zip(*columns, strict=True):
                if group != key:
                    key, number, total, first = group, 0, 0.0, True
                if not first and total + seconds > limit:
                    number, total = number + 1, 0.0
                total, first = total + seconds, False
                out.append(number)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keys) + 1], pa.array(out, pa.int32())], names=[*keys, "qid", "batch"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", qid long, batch int"
    rows = queries.select(*keys, F.col("qid").cast("long").alias("qid"), F.col("seconds").cast("double").alias("seconds"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "qid", "seconds").mapInArrow(run, schema)


def effect(rows: DataFrame, changes: DataFrame, queries: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(qid, n_pre, n_post, lost, gained): what a set of changes does to equality queries (qid, field, value).

    ``changes``: ``op`` (insert, update or delete), the key and the fields, whole
    rows for inserts and updates. Postings are counted on the table once; after
    that only the changed rows are looked at, in their old form and their new
    one: a query loses ids that only the old form meets and gains those that only
    the new form meets. ``lost`` and ``gained`` are sorted ids, as many as there
    are changes at most. Changes of keys that are missing (update, delete) or
    there already (insert) do nothing.
    """
    named = changes.select(F.col("op").alias("_op"), F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    met = rows.select(key, *fields).join(named, F.col(key) == F.col("_key"), "right")
    good = met.where((F.col("_op") == "insert") == F.col(key).isNull())
    old = evaluate_equal(good.where("_op <> 'insert'").select(key, *fields), queries, key, fields)
    new = evaluate_equal(good.where("_op <> 'delete'").select(F.col("_key").alias(key), *[F.col(f"_{f}").alias(f) for f in fields]), queries, key, fields)
    both = old.select("qid", "id", F.lit(1).alias("was"), F.lit(0).alias("now")).union(new.select("qid", "id", F.lit(0), F.lit(1)))
    moved = both.groupBy("qid", "id").agg(F.max("was").alias("was"), F.max("now").alias("now")).where("was <> now")
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) == 1, F.col("id"))))
    delta = moved.groupBy("qid").agg(F.sum(F.col("now") - F.col("was")).alias("_d"), listed("was").alias("lost"), listed("now").alias("gained"))
    none = F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>")
    counts = queries.select("qid").distinct().join(counted(evaluate_equal(rows, queries, key, fields)), "qid", "left").withColumn("n_pre", F.coalesce("n", F.lit(0)))
    return counts.join(delta, "qid", "left").select("qid", "n_pre", (F.col("n_pre") + F.coalesce("_d", F.lit(0))).alias("n_post"), F.coalesce("lost", none).alias("lost"), F.coalesce("gained", none).alias("gained"))


def value_candidates(distribution: DataFrame, field: str, value: str, category: str, low: float, high: float, n: int, seed: int) -> DataFrame:
    """Up to ``2 n`` equality candidates of a field whose share of the rows lies in [low, high], by seeded hash order."""
    total = distribution.agg(F.sum("weight").alias("_t"))
    share = F.col("weight") / F.col("_t")
    rows = distribution.crossJoin(F.broadcast(total)).where((share >= low) & (share <= high))  # one row
    shown = F.col(value).cast("string")
    where = F.concat(F.lit(f"{field} = '"), F.upper(shown), F.lit("'"))
    picked = rows.select(F.lit(category).alias("category"), F.lit(field).alias("field"), shown.alias("value"), where.alias("where"), F.xxhash64(F.lit(seed), shown).alias("h"))
    return picked.dropDuplicates(["where"]).orderBy("h", "where").limit(2 * n).drop("h")


def range_candidates(distribution: DataFrame, field: str, value: str, low: float, high: float) -> DataFrame:
    """One-sided bounds whose matching share lies in [low, high]: (side, bound, share)."""
    rows = cumulative(distribution, [value], "weight", "cum_weight")
    up, down = F.col("cum_weight") / F.col("total"), (F.col("total") - F.col("cum_weight") + F.col("weight")) / F.col("total")
    sides = F.array(F.struct(F.lit("le").alias("side"), up.alias("share")), F.struct(F.lit("ge").alias("side"), down.alias("share")))
    return rows.select(F.lit(field).alias("field"), F.col(value).alias("bound"), F.explode(sides).alias("s")).select("field", "s.side", "bound", "s.share").where((F.col("share") >= low) & (F.col("share") <= high))


def check_schema(requests: DataFrame, db_size: int, categories: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(row, fault) for each broken rule: known category and field, 0 <= lower <= upper <= size, 1 <= m <= n <= 6."""
    rules = {
        "unknown category": ~F.col("category").isin(*categories), "unknown field": ~F.col("field").isin(*fields),
        "lower bound below 0": F.col("lower") < 0, "upper bound below lower": F.col("upper") < F.col("lower"),
        "upper bound above the table": F.col("upper") > db_size, "m above n": F.col("m") > F.col("n"), "m below 1": F.col("m") < 1, "more than 6 terms": F.col("n") > 6,
    }
    faults = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return requests.select("row", F.explode(faults).alias("fault"))
