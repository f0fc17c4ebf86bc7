"""Steps whose tasks must not grow with a table: what is shuffled by which key, and the same results."""

import itertools
import re

from harness import DATA
from pyspark.sql import functions as F

from sextant import registry
from sextant.operators import candidates, logs, workload
from sextant.streaming import pubsub


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_shuffled_by_file(spark):
    lines = spark.createDataFrame([("f", 1, "[1.0] ID 0-1 sent"), ("f", 2, "[2.0] END_OF_LOG"), ("f", 3, "[3.0] ID 0-2 sent"), ("g", 9, "[4.0] ID 0-3 sent")], "file string, line long, value string")
    assert "hashpartitioning(file" not in plan(logs._clean(lines))
    assert sorted(r.cmd for r in logs.commands(lines, 3).collect()) == ["0-1", "0-3"]


def test_thresholds_count_rows_before_they_join_terms(spark):
    matches = spark.createDataFrame([(q, i) for q, i in itertools.product(range(3), range(60)) if i % (q + 2) == 0], "qid long, id long")
    combos = spark.createDataFrame([(c, 1 + c, q) for c in range(2) for q in range(3)], "cid long, m int, qid long")
    got = workload.thresholds(combos, matches)
    hits = [sum(i % k == 0 for k in (2, 3, 4)) for i in range(60)]
    assert {(r.cid, r.matched): r.n for r in got.collect()} == {(c, k): hits.count(k) for c in range(2) for k in range(1 + c, 4) if hits.count(k)}
    assert "hashpartitioning(cid" not in plan(got) or "pattern" in plan(got)


def test_xml_entries_meet_by_row(spark):
    index = spark.createDataFrame([(1, "/a/b", "b", "x"), (1, "/a/b", "b", "X"), (2, "/a/b", "b", "x")], "id long, path string, tag string, value string")
    got = candidates.xml_candidates(index, "xml", 1, 9)
    assert {(r.xpath, r.search_for, r.n) for r in got.collect()} == {("/a/b", "X", 2), ("//b", "X", 2)}
    assert "hashpartitioning(id" in plan(got) and "hashpartitioning(id#" in plan(got).replace(" ", "")


def test_deliveries_of_a_shared_body_are_told_apart_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(pubsub, "PAIRS", 50)  # so that bodies are dealt
    pubs = spark.createDataFrame([(i, i % 7, i % 10) for i in range(140)], "k long, u long, n long")
    rows = [t for s in range(7) for t in [(s, 0, 0, False, "u", "=", str(s), None, None), (s, 1, 0, False, "n", ">=", "6", 6.0, None), (s, 2, 0, False, "n", "=", "3", 3.0, None)]]
    found = pubsub.match(pubs, spark.createDataFrame(rows, pubsub.TERMS), "k", ["u", "n"])
    want = sorted((i, s) for i in range(140) for s in range(7) if i % 7 == s or i % 10 >= 6 or i % 10 == 3)
    assert sorted(map(tuple, found.collect())) == want
    assert not re.search(r"keys=\[pub#\d+L?, sub#\d+L?\]", plan(found))  # only the other bodies' pairs are, with the first body
    spans = spark.createDataFrame([(s, 10 * s, None if s % 2 else 100) for s in range(7)], "sub long, start long, end long")
    active = pubsub.match(pubs.withColumn("t", F.col("k")), spark.createDataFrame(rows, pubsub.TERMS), "k", ["u", "n"], "t", spans)
    assert sorted(map(tuple, active.collect())) == [(i, s) for i, s in want if i >= 10 * s and (s % 2 or i < 100)]


def test_shapes_of_texts_are_made_in_many_tasks(spark):
    found = registry.queries()["fn_expr_shape"](spark, DATA)
    assert len({r[0] for r in found.select(F.spark_partition_id()).collect()}) > 1


def test_word_triples_shuffle_fewer_bytes(spark):
    """Three words go through the shuffle as one text, any text among them; the counts are those of a plain grouping."""
    from pyspark.sql import functions as F

    from sextant.operators import distributions

    made = [F.concat(F.lit(p), (F.xxhash64("id", F.lit(p)) % 50).cast("string")) for p in ("a:1", "word", "ä ", "")]
    docs = spark.range(20_000).select("id", F.array(*made, F.lit("")).alias("t"))
    back = [F.when(F.col("k") + i > 0, F.get("t", F.col("k") + i - 1)).otherwise("").alias(n) for i, n in ((-2, "first"), (-1, "second"), (0, "following"))]
    plain = docs.select("t", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select(*back).groupBy("first", "second", "following").agg(F.count("*").alias("n"))

    def sent(df):
        store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
        before = store().apply(0).totalShuffleWrite()
        rows = sorted(map(tuple, df.collect()))
        return rows, store().apply(0).totalShuffleWrite() - before

    (got, less), (want, more) = sent(distributions.next_words(docs, "id", F.col("t"))), sent(plain)
    assert got == want and 0 < less < 0.9 * more


def test_walks_do_not_shuffle_the_model_again(spark):
    """Words that a walk is long cost shuffles of the walks, not of the model."""
    from pyspark.sql import functions as F

    from sextant.operators import synth

    words = [F.concat(F.lit("w"), (F.xxhash64("id", F.lit(k)) % 40).cast("string")).alias(n) for k, n in enumerate(("first", "second", "following"))]
    model = spark.range(60_000).select(*words).groupBy("first", "second", "following").agg(F.count("*").alias("n"))
    model = model.union(model.select(F.lit(""), F.lit(""), "first", "n")).union(model.select(F.lit(""), "first", "second", "n"))
    model = model.groupBy("first", "second", "following").agg(F.sum("n").alias("n"))

    def sent(length):
        store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
        before = store().apply(0).totalShuffleWrite()
        made = synth.texts(spark.range(20), model, "id", length, 5).collect()
        assert len(made) == 20 and all(0 < len(r.text) <= length for r in made)
        return store().apply(0).totalShuffleWrite() - before

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a model of any size
    try:
        few, many = sent(8), sent(40)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert many < 1.2 * few
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sextant_")]


def _records_sent(spark, run):
    """What ``run`` gives, and the bytes that it shuffled."""
    store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
    before = store().apply(0).totalShuffleWrite()
    return run(), store().apply(0).totalShuffleWrite() - before


def test_audits_shuffle_a_fraction_of_the_pairs(spark):
    pairs = spark.range(0, 40, 1, 4).select(F.col("id").alias("pub"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4999).cast("long"))).alias("sub"))
    actual = pairs.where("pub % 9 <> 0").union(pairs.where("pub % 8 = 0 and sub < 7").select("pub", -F.col("sub") - 1))
    odd = spark.createDataFrame([(None, 1), (3, None)], "pub long, sub long")

    def counts(found):
        return dict(map(tuple, found.groupBy("status").agg(F.count("*")).collect()))

    got, less = _records_sent(spark, lambda: counts(pubsub.audit(pairs.union(odd), actual.union(odd))))
    want, more = _records_sent(spark, lambda: counts(pubsub._audit_plain(pairs.union(odd), actual.union(odd))))
    assert got == want == {"right": 35 * 5000, "missing": 5 * 5000 + 2, "extra": 5 * 7 + 2} and less < more / 10
    found = pubsub.audit(pairs, actual).where("pub = 8").select("sub", "status").collect()
    assert sorted(map(tuple, found)) == sorted([(s, "right") for s in range(5000)] + [(-1 - s, "extra") for s in range(7)])


def test_written_tables_leave_no_shuffles(spark):
    from pathlib import Path

    from sextant.scratch import written

    local = Path(spark.conf.get("spark.local.dir"))
    shuffles = lambda: {f.name for f in local.rglob("shuffle_*.data")}
    before = shuffles()
    assert written(spark.range(5000).repartition(4, "id")).count() == 5000
    left = {n.split("_")[1] for n in shuffles() - before}
    assert len(left) <= 1  # that of the count


def test_views_are_not_left_behind(spark):
    assert registry.queries()["u_1"](spark, DATA).count() > 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sextant_u")]
