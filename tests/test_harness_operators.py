"""User aggregators, effects of modifications, and answers to commands, batch and stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sextant.operators import user, workload
from sextant.plans.harness import Largest
from sextant.streaming import pubsub


def median():
    # made here, so that workers get the class by value
    class Median(user.Aggregator):
        """An exact median from a histogram, with the group's null count."""

        result = "median double, nulls long"

        def start(self):
            return {}, 0

        def add(self, state, value):
            counts, nulls = state
            if value is None:
                return counts, nulls + 1
            counts[value] = counts.get(value, 0) + 1
            return counts, nulls

        def merge(self, a, b):
            return {k: a[0].get(k, 0) + b[0].get(k, 0) for k in a[0] | b[0]}, a[1] + b[1]

        def finish(self, state):
            values = sorted(v for v, n in state[0].items() for _ in range(n))
            return (values[(len(values) - 1) // 2] if values else None), state[1]

    return Median()


def test_user_aggregates_equal_one_group_forms(spark, monkeypatch):
    pick = random.Random(2)
    made = [(pick.choice(["a", "b", None]), pick.randint(0, 1), pick.choice([None, *map(float, range(9))])) for _ in range(3000)] + [("hot", 0, float(i % 50)) for i in range(5000)]
    df = spark.createDataFrame(made, "k string, j int, v double").repartition(7)
    got = {(r.k, r.j): (r.median, r.nulls) for r in user.aggregate(df, ["k", "j"], ["v"], median()).collect()}
    want = {}
    for k, j in {m[:2] for m in made}:
        state = median().start()
        for m in made:
            if m[:2] == (k, j):
                state = median().add(state, m[2])
        want[k, j] = median().finish(state)
    assert got == want
    one = user.aggregate(df, [], ["v"], Largest(2)).collect()
    assert [tuple(r) for r in one] == [(sum(m[2] is not None for m in made), [49.0, 49.0])]
    none = user.aggregate(df.where("k = 'nobody'"), [], ["v"], Largest(2)).collect()
    assert [tuple(r) for r in none] == [(0, [])]
    assert user.aggregate(df.where("k = 'nobody'"), ["k"], ["v"], Largest(2)).count() == 0
    many = spark.range(40_000).select((F.col("id") % 25_000).alias("k"), F.lit(1.0).alias("v")).repartition(2)
    assert user.aggregate(many, ["k"], ["v"], Largest(1)).agg(F.count("*"), F.sum("n")).first()[:] == (25_000, 40_000)


def test_user_states_only_are_shuffled(spark):
    df = spark.range(0, 50_000, 1, 4).select(F.lit("one").alias("k"), F.col("id").cast("double").alias("v"))
    out = user.aggregate(df, ["k"], ["v"], Largest(3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("MapInArrow") and [tuple(r) for r in out.collect()] == [("one", 50_000, [49_999.0, 49_998.0, 49_997.0])]


def test_effect_equals_evaluating_both_tables(spark):
    pick = random.Random(4)
    table = {i: (pick.choice("abc"), pick.choice("xy")) for i in range(60)}
    changes = [("delete", i, None, None) for i in range(0, 60, 7)] + [("update", i, pick.choice("abc"), pick.choice("xy")) for i in range(1, 60, 7)] + [("insert", 100 + i, "a", "y") for i in range(5)]
    odd = [("insert", 2, "c", "x"), ("delete", 999, None, None), ("update", 998, "a", "x")]  # there already, missing, missing
    after = dict(table)
    for op, i, a, b in changes:
        if op == "delete":
            del after[i]
        else:
            after[i] = (a, b)
    queries = [(1, "f", "a"), (2, "f", "C"), (3, "g", "y"), (4, "g", "none")]
    out = workload.effect(
        spark.createDataFrame([(i, *v) for i, v in table.items()], "id long, f string, g string"), spark.createDataFrame(changes + odd, "op string, id long, f string, g string"),
        spark.createDataFrame(queries, "qid long, field string, value string"), "id", ["f", "g"],
    )
    met = lambda rows, field, value: {i for i, v in rows.items() if v["fg".index(field)].upper() == value.upper()}
    for r in out.collect():
        _, field, value = queries[r.qid - 1]
        pre, post = met(table, field, value), met(after, field, value)
        assert (r.n_pre, r.n_post, r.lost, r.gained) == (len(pre), len(post), sorted(pre - post), sorted(post - pre))
    assert out.count() == 4


def test_answers_to_commands_batch_and_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    commands = [(i, at(10 * i)) for i in range(60)]
    answers = [(i, at(10 * i + i % 9)) for i in range(60) if i % 5] + [(7, at(70 + 8)), (8, at(80 + 500)), (99, at(100))]
    make = lambda rows: spark.createDataFrame(rows, "cmd long, at timestamp")
    batch = {(r.cmd, r.latency) for r in pubsub.command_latency(make(commands), make(answers), "cmd", "at", "30 seconds").collect()}
    assert batch == {(i, float(i % 9) if i % 5 else None) for i in range(60)}
    for name, rows in (("c", commands), ("a", answers)):
        for k in range(6):
            make([r for r in rows if k * 100 <= (r[1] - at(0)).total_seconds() < (k + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    make([(1000, at(2000))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    make([(1000, at(2001))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    read = lambda name: spark.readStream.schema("cmd long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = pubsub.command_latency(read("c"), read("a"), "cmd", "at", "30 seconds")
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    stream = {(r.cmd, r.latency) for r in spark.read.parquet(str(tmp_path / "out")).collect()} - {(1000, 1.0)}
    assert stream == batch


def test_changing_subscriptions_on_streams_are_the_batch(spark, tmp_path):
    """Both inputs come shuffled within the delay, with repeated subscribes, ties, and rows without ids."""
    import random

    rng = random.Random(3)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    changes = [(sub, at(t), rng.random() < 0.6) for sub in range(6) for t in sorted(rng.sample(range(600), 12))] + [(None, at(5), True)]
    sent = [(p, rng.randrange(8), at(rng.randrange(600))) for p in range(900)] + [(5000, None, at(6))]
    kinds = {"c": "sub long, at timestamp, active boolean", "d": "pub long, sub long, at timestamp"}
    batch = spark.createDataFrame(sent, kinds["d"])
    spans = pubsub.validity(spark.createDataFrame(changes, kinds["c"]).where("sub is not null"))
    pubs = batch.select(batch["pub"].alias("k"), "at")
    want = sorted(tuple(r) for r in pubsub.active_only(batch.select("pub", "sub"), pubs, spans, "k", "at").collect())
    assert 100 < len(want) < 800
    for name, rows, time in (("c", changes, 1), ("d", sent, 2)):
        for k in range(5):
            part = [r for r in rows if k * 120 <= (r[time] - at(0)).total_seconds() + 59 * (hash(r[:1]) % 2) < (k + 1) * 120 or (k == 4 and (r[time] - at(0)).total_seconds() + 59 * (hash(r[:1]) % 2) >= 600)]
            rng.shuffle(part)
            spark.createDataFrame(part, kinds[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        for far in (2000, 3000):
            end = [(99, at(far), True)] if name == "c" else [(9999, 98, at(far))]
            spark.createDataFrame(end, kinds[name]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(kinds[name]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = pubsub.active_stream(read("d"), read("c"), "at", "2 minutes", 2)
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
    finally:
        spark.conf.set(key, before)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
