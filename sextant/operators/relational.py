"""Joins, set operations, ordering and changes of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_view(base: DataFrame, *parts: DataFrame, key: str = "id") -> DataFrame:
    """The tables of a vertically split row, joined on its key."""
    for part in parts:
        base = base.join(part, key)
    return base


def join_graph(tables: dict[str, DataFrame], start: str, edges: Sequence[tuple[str, str, str, str]], wanted: Sequence[str]) -> DataFrame:
    """Inner joins from ``start`` to each wanted table along edges (table, column, table, column)."""
    from_ = {start: None}
    queue = [start]
    while queue:
        here = queue.pop(0)
        for a, ca, b, cb in edges:
            for x, cx, y, cy in ((a, ca, b, cb), (b, cb, a, ca)):
                if x == here and y not in from_:
                    from_[y] = (x, cx, cy)
                    queue.append(y)
    needed: list[str] = []
    for t in wanted:
        path = []
        while t != start:
            if t not in from_:
                raise ValueError(f"no path to {t}")
            path.append(t)
            t = from_[t][0]
        needed += [p for p in reversed(path) if p not in needed]
    out = tables[start]
    for t in needed:
        _, cx, cy = from_[t]
        out = out.join(tables[t], F.col(cx) == F.col(cy))
    return out


def fold_children(parents: DataFrame, children: DataFrame, junction: DataFrame, parent_key: str, child_key: str, order: str, folds: dict[str, str]) -> DataFrame:
    """Many-to-many: each parent with its children's fields folded in junction order.

    A fold is ``list``, ``sum``, or ``same``: the common value, null if they differ.
    """
    rows = junction.join(children, child_key)
    kinds = {
        "list": lambda c: F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda s: s[c]),
        "sum": lambda c: F.sum(c),
        "same": lambda c: F.when(F.min(c) == F.max(c), F.min(c)),
    }
    return parents.join(rows.groupBy(parent_key).agg(*[kinds[k](c).alias(c) for c, k in folds.items()]), parent_key)


def compare(left: DataFrame, right: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """A full keyed compare: ``status`` is equal, differs, missing (in ``right``) or extra."""
    a = left.select(*key, F.struct(*payload).alias("l"))
    b = right.select(*key, F.struct(*payload).alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("l").eqNullSafe(F.col("r")), "equal").otherwise("differs")
    return a.join(b, list(key), "full_outer").select(*key, status.alias("status"))


def as_of(rows: DataFrame, marks: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each row with ``value`` of the latest mark at or before its time; rows before the first mark take the first.

    One sort of the union by series and time, no comparison of rows with marks.
    """
    kind = marks.schema[value].dataType
    both = rows.withColumn("_mark", F.lit(None).cast(kind)).withColumn("_is", F.lit(1)).unionByName(
        marks.select(*by, time, F.col(value).alias("_mark")).withColumn("_is", F.lit(0)), allowMissingColumns=True
    )
    up_to = Window.partitionBy(*by).orderBy(time, "_is").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(time, "_is").rowsBetween(0, Window.unboundedFollowing)
    found = F.coalesce(F.last("_mark", True).over(up_to), F.first("_mark", True).over(after))
    return both.withColumn(value, found).where("_is = 1").drop("_mark", "_is")


def within(rows: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the spans that contain their time (seconds), bounds included.

    Both sides meet in buckets of ``width`` seconds: a span goes to each bucket it
    touches, a row to one.
    """
    cut = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    marked = rows.withColumn("_bucket", F.floor(F.col(at) / width))
    joined = marked.join(cut, ["_bucket", *by])
    return joined.where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bucket")


def fill_hashes(queries: DataFrame, hashes: DataFrame, ids: str = "ids", key: str = "qid") -> DataFrame:
    """Per query the row hashes of its ids, in their order, and how many ids have no hash or several."""
    rows = queries.select(key, F.posexplode(ids).alias("pos", "id"))
    counted = hashes.groupBy("id").agg(F.count("*").alias("n"), F.min("hash").alias("hash"))
    joined = rows.join(counted, "id", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda s: s["hash"])
    return joined.groupBy(key).agg(ordered.alias("hashes"), F.count(F.when(F.coalesce("n", F.lit(0)) != 1, 1)).alias("n_bad"))


def ranked(c: str, order: Sequence[str]) -> Column:
    """The place of a label in a declared order; unknown labels come last."""
    pairs = [F.lit(x) for i, v in enumerate(order) for x in (v, i)]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(c)), F.lit(len(order)))


def distinct_sorted(rows: DataFrame, columns: Sequence[str], ranks: dict[str, Sequence[str]] | None = None) -> DataFrame:
    ranks = ranks or {}
    return rows.select(*columns).distinct().orderBy(*[ranked(c, ranks[c]) if c in ranks else F.col(c) for c in columns])


def page(rows: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(key).offset(offset).limit(limit)


def sample_one(rows: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """One row of each group, by the smallest seeded hash of its key: a group is never gathered."""
    best = rows.groupBy(by).agg(F.min_by(key, F.struct(F.xxhash64(F.lit(seed), key), key)).alias("_key"))
    return rows.join(best.withColumnRenamed(by, "_by"), (F.col(by) == F.col("_by")) & (F.col(key) == F.col("_key"))).drop("_by", "_key")


def constrained(rows: DataFrame, constraints: dict[str, object], extra: Sequence[Column] = ()) -> DataFrame:
    """Equality constraints: None means null or empty, booleans mean truth, the rest equality."""
    kinds = dict(rows.dtypes)
    for c, v in constraints.items():
        if v is None:
            rows = rows.where(F.col(c).isNull() | ((F.col(c) == "") if kinds[c] == "string" else F.lit(False)))
        elif isinstance(v, bool):
            rows = rows.where(F.coalesce(F.col(c).cast("boolean"), F.lit(False)) == v)
        else:
            rows = rows.where(F.col(c) == v)
    for e in extra:
        rows = rows.where(e)
    return rows


def update(rows: DataFrame, column: str, value: Column, condition: Column) -> DataFrame:
    return rows.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str = "id", order: str = "seq", kind: str = "op") -> DataFrame:
    """Inserts, updates and deletes by key; of several changes of a key the last one wins.

    ``changes`` has all columns of ``rows`` (null in an update: unchanged), ``order``
    and ``kind``. An update of a missing key is an insert.
    """
    columns = [c for c in rows.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(F.col(kind).alias("_op"), *columns), order).alias("_n"))
    joined = rows.withColumn("_old", F.struct(*columns)).select(key, "_old").join(last, key, "full_outer")
    values = [F.when(F.col("_n").isNull() | (F.col("_n._op") == "update"), F.coalesce(F.col(f"_n.{c}"), F.col(f"_old.{c}"))).otherwise(F.col(f"_n.{c}")).alias(c) for c in columns]
    return joined.where(F.coalesce(F.col("_n._op"), F.lit("")) != "delete").select(key, *values)


def apply_to_index(index: DataFrame, rebuilt: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """An index with the entries of changed keys replaced by those of ``rebuilt``."""
    touched = changes.select(key).distinct()
    return index.join(touched, key, "left_anti").unionByName(rebuilt.join(touched, key, "left_semi"))


def verify(asked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Whether each asked key is there exactly once."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return asked.select(key).distinct().join(counts, key, "left").select(key, (F.coalesce("n", F.lit(0)) == 1).alias("verified"))
