"""Registered queries: harness logs, written line by line from the tables and parsed back; modifications, answers to
commands, and an aggregator of the user's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import predicates as P
from sextant.operators import logs, user
from sextant.operators import workload as W
from sextant.streaming import pubsub

from ._tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(rows: DataFrame, key: str, file: Column, made: list[tuple[Column | None, Column]]) -> DataFrame:
    """(file, line, value): for each row the lines whose condition holds, in order of the key."""
    step = 2 * len(made)
    listed = F.array(*[F.when(c if c is not None else F.lit(True), F.struct((F.col(key) * step + i).alias("line"), v.alias("value"))) for i, (c, v) in enumerate(made)])
    return rows.select(file.alias("file"), F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("l")).select("file", "l.line", "l.value")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


_CASE = "coalesce(CAST(max(CASE WHEN event_id % 20 = 0 THEN event_id END) OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS VARCHAR), '000')"


@query(f"""SELECT event_id, test_case, user_id AS qid, event_type AS cols, 0.5 AS latency, CASE WHEN event_type = 'error' THEN [] ELSE [event_id] END AS ids,
 CASE WHEN event_type = 'error' OR event_id % 2 = 1 THEN [] ELSE [md5(event_type)] END AS hashes, CASE WHEN event_type = 'click' THEN [CAST(user_id AS VARCHAR)] ELSE [] END AS event_values,
 CASE WHEN event_type = 'error' THEN ['FAILED', 'broken ' || user_id] ELSE [] END AS status
 FROM (SELECT *, {_CASE} AS test_case FROM events) WHERE event_id % 11 <> 0""")
def log_1(spark: SparkSession, d: str) -> DataFrame:
    """A client log in three files with a command an event; every eleventh is never sent, errors fail with a text of their own."""
    e, k = table(spark, d, "events"), F.col("event_id")
    stamp = lambda more: _text("[", k, more, "] ID 0-", k)
    kind, bad = F.col("event_type"), F.col("event_type") == "error"
    rows = _lines(e, "event_id", k % 3, [
        (k % 20 == 0, _text("[", k, ".0] 2024-01-01 00:00:00 PERF-x-", k, "_y")), (k % 11 != 0, _text(stamp(".0"), " sent")),
        (None, _text(stamp(".0"), " QID ", F.col("user_id"), ": [[SELECT ", kind, " FROM main WHERE user = ", F.col("user_id"), "]]")),
        (kind == "click", _text(stamp(".25"), " event 9 with value [[", F.col("user_id"), "]] occurred")), (None, _text(stamp(".5"), " results:")),
        (bad, _text("FAILED as ", F.col("user_id"))), (bad, _text("broken ", F.col("user_id"))), (bad, F.lit("ENDFAILED")),
        (~bad, F.when(k % 2 == 0, _text(k, " ", F.md5(kind))).otherwise(_text(k))), (k % 5 == 0, F.lit("  ")),
    ])
    out = logs.client(rows)
    return out.select(F.substring_index("cmd", "-", -1).cast("long").alias("event_id"), "test_case", "qid", "cols", F.col("latency").cast("decimal(3,1)").alias("latency"), F.col("ids").cast("array<bigint>").alias("ids"), "hashes", "event_values", "status")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS mid, CASE o_orderstatus WHEN 'O' THEN 'insert' WHEN 'F' THEN 'delete' END AS category, o_custkey AS record_id,
 CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 2 END AS verification, o_orderkey % 7 = 0 AS failed, CASE WHEN o_orderkey % 7 = 0 THEN ['no ' || o_custkey] ELSE [] END AS failures, 0.25 AS latency FROM orders""")
def log_2(spark: SparkSession, d: str) -> DataFrame:
    """A server log in four files with a modification or verification an order."""
    o, k, s = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    stamp = lambda more: _text("[", k, more, "] ID 3-", k)
    bad = k % 7 == 0
    verb = F.when(s == "O", F.lit("INSERT")).otherwise(F.lit("DELETE"))
    done = F.when(s == "P", F.when(k % 2 == 0, F.lit("VERIFY FALSE")).otherwise(F.lit("VERIFY TRUE"))).otherwise(F.when(bad, F.lit("FAILED")).otherwise(F.lit("DONE")))
    rows = _lines(o, "o_orderkey", k % 4, [
        (None, _text(stamp(".0"), " sent")), (s != "P", _text(stamp(".0"), " MID ", F.col("o_custkey"), ": ", verb, " ", F.col("o_custkey"))), (s == "P", _text(stamp(".0"), " VERIFY ", F.col("o_custkey"))),
        (None, _text(stamp(".25"), " results: ", done)), (bad, F.lit("FAILED")), (bad, _text("no ", F.col("o_custkey"))), (bad, F.lit("ENDFAILED")),
    ])
    out = logs.server(rows)
    return out.select(F.substring_index("cmd", "-", -1).cast("long").alias("id"), "mid", "category", F.col("record_id").cast("long").alias("record_id"), F.col("verification").cast("long").alias("verification"), (F.col("failed") == 1).alias("failed"), "failures", F.col("latency").cast("decimal(3,2)").alias("latency"))


@query("""SELECT p_partkey AS id, 'T' || p_partkey // 9 AS test, 'lab' AS performer, CASE p_size % 3 WHEN 0 THEN 'KEYPARAMS' WHEN 1 THEN 'CIRCUIT' ELSE 'INPUT' END AS section, 'f' || p_size AS path, p_size > 40 AS recovery,
 CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN NULL ELSE p_brand END AS result, CASE WHEN p_size % 3 = 1 THEN 1 ELSE 2 END AS n FROM part""")
def log_3(spark: SparkSession, d: str) -> DataFrame:
    """A circuit log with a record a part; the test is named once in nine records, values of other sections are noise."""
    p, k, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    section = F.when(size % 3 == 0, F.lit("KEYPARAMS")).when(size % 3 == 1, F.lit("CIRCUIT")).otherwise(F.lit("INPUT"))
    rows = _lines(p, "p_partkey", F.lit("c"), [
        (k % 9 == 0, _text("TEST: T", F.floor(k / 9), " at ", k)), (k == 0, F.lit("PERFORMER: lab")), (None, _text(section, ": f", size)), (size > 40, F.lit("RECOVERY")), (None, F.lit("noise")),
        (None, F.when(size % 3 == 0, _text("KEYGEN: 0.", size)).when(size % 3 == 1, _text("INGESTION: 1.", size)).otherwise(_text("DECRYPTED RESULT: early"))), (size % 3 == 1, F.lit("KEYSIZE: 1")),
        (size % 3 == 0, _text("KEYSIZE: ", size)), (size % 3 == 2, _text("DECRYPT: ", size)), (size % 3 == 2, _text("DECRYPTED RESULT: ", F.col("p_brand"))),
    ])
    out = logs.circuit(rows)
    result = F.coalesce(F.col("measures")["KEYSIZE"], F.col("measures")["DECRYPTED RESULT"])
    return out.select(F.floor(F.col("record") / 20).alias("id"), "test", "performer", "section", "path", "recovery", result.alias("result"), F.size("measures").alias("n"))


# -- modifications, answers, user aggregators ---------------------------------------------------------------------


@query("""WITH post AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN 'F' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 0
 UNION ALL SELECT o_orderkey + 1000000000, 'P' FROM orders WHERE o_orderkey % 10 = 2),
 n AS (SELECT s AS q, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n_pre, (SELECT count(*) FROM post WHERE post.s = v.s) AS n_post,
 (SELECT count(*) FROM orders o WHERE o_orderstatus = s AND NOT EXISTS (SELECT 1 FROM post WHERE post.id = o_orderkey AND post.s = v.s)) AS n_lost,
 (SELECT min(id) FROM post WHERE post.s = v.s AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = id AND o_orderstatus = v.s)) AS first_gained FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) v)
 FROM n""")
def wl_mods_effect(spark: SparkSession, d: str) -> DataFrame:
    """Status queries before and after a tenth of the orders is deleted, a tenth set to F and as many added as P."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    op = F.when(k % 10 == 0, "delete").when(k % 10 == 1, "update").when(k % 10 == 2, "insert")
    changes = o.where("o_orderkey % 10 < 3").select(op.alias("op"), F.when(k % 10 == 2, k + 1_000_000_000).otherwise(k).alias("o_orderkey"), F.when(k % 10 == 1, "F").when(k % 10 == 2, "P").otherwise(s).alias("o_orderstatus"))
    named = o.select(s.alias("value")).distinct().select(F.crc32("value").alias("qid"), F.lit("o_orderstatus").alias("field"), "value")
    out = W.effect(o, changes, named, "o_orderkey", ["o_orderstatus"]).join(named, "qid")
    return out.select(F.col("value").alias("q"), "n_pre", "n_post", F.size("lost").cast("long").alias("n_lost"), F.get("gained", F.lit(0)).alias("first_gained"))


@query("""SELECT event_id, CASE WHEN event_id % 6 <> 0 AND value <= 60 THEN CAST(floor(value * 1000) AS BIGINT) / 1000.0 END AS latency FROM events WHERE event_id % 2 = 0""")
def ps_sublat(spark: SparkSession, d: str) -> DataFrame:
    """Every other event is a command; two of three are answered ``value`` seconds later, twice, and count within a minute."""
    e = table(spark, d, "events").where("event_id % 2 = 0")
    later = lambda more: F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000) * 1000 + more)
    commands = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    answered = e.where("event_id % 6 <> 0")
    answers = answered.select("event_id", later(0).alias("ts")).union(answered.select("event_id", later(5_000_000)))
    return pubsub.command_latency(commands, answers, "event_id", "ts", "60 seconds").select("event_id", "latency")


class Largest(user.Aggregator):
    """The number of values and the largest few, in falling order."""

    result = "n long, largest array<double>"

    def __init__(self, k: int) -> None:
        self.k = k

    def start(self) -> tuple:
        return 0, []

    def add(self, state: tuple, value: float | None) -> tuple:
        n, top = state
        if value is None:
            return state
        return n + 1, sorted([*top, value], reverse=True)[: self.k] if len(top) < self.k or value > top[-1] else top

    def merge(self, a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], sorted(a[1] + b[1], reverse=True)[: self.k]

    def finish(self, state: tuple) -> tuple:
        return state


@query("SELECT event_type, count(value) AS n, list_slice(list_sort(list(value), 'DESC', 'NULLS LAST'), 1, 3) AS largest FROM events GROUP BY 1")
def u_3(spark: SparkSession, d: str) -> DataFrame:
    return user.aggregate(table(spark, d, "events"), ["event_type"], ["value"], Largest(3))


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT + (o_totalprice >= 200000)::INT AS score FROM orders WHERE (o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT + (o_totalprice >= 200000)::INT >= 2")
def u_1(spark: SparkSession, d: str) -> DataFrame:
    """The threshold as a function in SQL text."""
    P.register(spark)
    score = "m_of_n(2, array(o_orderstatus = 'F', o_orderpriority = '1-URGENT', o_totalprice >= 200000))"
    return spark.sql(f"SELECT o_orderkey, {score} AS score FROM {{orders}} WHERE {score} >= 2", orders=table(spark, d, "orders"))  # leaves no view behind
