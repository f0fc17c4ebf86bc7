"""Registered queries: workloads, scoring, logs, publish and subscribe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import predicates as P
from sextant.functions import scalars as S
from sextant.operators import distributions as D
from sextant.operators import logs, perf, scoring, synth, windows
from sextant.operators import relational as R
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


# -- workload: every (field, value) of two columns is an equality query --------------------------------


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """(qid, field, value): an equality query for each segment and each nation of the customers."""
    c = table(spark, d, "customer")
    values = W.cells(c, "c_custkey", ["c_mktsegment", "c_nationkey"]).select("field", "value").distinct()
    return values.select((F.crc32(F.concat_ws("=", "field", "value")) % 100000007).alias("qid"), "field", "value")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return W.evaluate_equal(table(spark, d, "customer"), _terms(spark, d), "c_custkey", ["c_mktsegment", "c_nationkey"])


# DuckDB has no CRC-32, so its side names queries by text; results are compared by text too.
_T = "SELECT 'c_mktsegment=' || c_mktsegment AS q, 'c_mktsegment' AS field, c_custkey AS id FROM customer UNION ALL SELECT 'c_nationkey=' || c_nationkey, 'c_nationkey', c_custkey FROM customer"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("qid", F.concat_ws("=", "field", "value").alias("q"))


@query(f"SELECT q, id FROM ({_T})")
def wl_eval(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).join(_named(spark, d), "qid").select("q", "id")


@query("SELECT 10 * floor(l / 10) AS low, o_orderkey AS id FROM (SELECT o_orderkey, o_totalprice, unnest(range(0, 500, 10)) AS l FROM orders) WHERE o_totalprice / 1000 BETWEEN l AND l + 15")
def wl_eval_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("v", F.col("o_totalprice") / 1000)
    q = spark.range(50).select(F.col("id").alias("qid"), (F.col("id") * 10.0).alias("low"), (F.col("id") * 10.0 + 15).alias("high"))
    return W.evaluate_ranges(o, q, "o_orderkey", "v", 10.0).select((F.col("qid") * 10.0).alias("low"), "id")


@query("SELECT 1 AS qid, o_orderkey AS id FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 3, o_orderkey FROM orders WHERE upper(o_orderpriority) LIKE '%LOW'")
def wl_eval_scan(spark: SparkSession, d: str) -> DataFrame:
    ps = [(1, P.starts("o_orderpriority", "1")), (2, F.col("o_totalprice") > 250000), (3, P.ends("o_orderpriority", "low"))]
    return W.evaluate_scan(table(spark, d, "orders"), ps, "o_orderkey")


@query(r"SELECT v AS value, doc_id AS id FROM documents, (VALUES ('THE'), ('FROM'), ('DER')) q(v) WHERE list_contains(regexp_split_to_array(upper(text), '[^\p{L}\p{N}'']+'), v)")
def a_multi(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(1, "the"), (2, "from"), (3, "der")], "qid long, value string")
    return W.evaluate_words(table(spark, d, "documents"), q, "doc_id", "text").join(q, "qid").select(F.upper("value").alias("value"), "id")


@query(f"SELECT q, count(*) AS n FROM ({_T}) GROUP BY 1 HAVING count(*) BETWEEN (SELECT count(*) FROM customer) // 30 AND (SELECT count(*) FROM customer) // 4")
def wl_refine(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "customer").count()
    q = _terms(spark, d).withColumns({"category": F.lit("EQ"), "lower": F.lit(size // 30), "upper": F.lit(size // 4)})
    return W.refine(q, _hits(spark, d)).select(F.concat_ws("=", "field", "value").alias("q"), "n")


_N = f"SELECT q, field, count(*) AS n FROM ({_T}) GROUP BY 1, 2"


@query(f"WITH t AS ({_T}), n AS ({_N}) SELECT least(a.q, b.q) AS a, greatest(a.q, b.q) AS b, count(*) AS \"both\" FROM t a JOIN t b ON a.id = b.id AND a.q < b.q AND a.field <> b.field JOIN n na ON na.q = a.q JOIN n nb ON nb.q = b.q WHERE na.n >= 2 AND nb.n >= 2 GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 100000")
def wl_and(spark: SparkSession, d: str) -> DataFrame:
    q = _named(spark, d)
    a, b = q.select(F.col("qid").alias("a"), F.col("q").alias("qa")), q.select(F.col("qid").alias("b"), F.col("q").alias("qb"))
    out = W.pairs(_hits(spark, d), _terms(spark, d).select("qid", "field"), 2, 100000).join(a, "a").join(b, "b")
    return out.select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b"), "both")


@query(f"WITH t AS ({_T}), n AS ({_N}) SELECT a.q AS a, b.q AS b, (SELECT count(DISTINCT id) FROM t WHERE t.q IN (a.q, b.q)) AS either FROM n a JOIN n b ON a.q < b.q AND a.field <> b.field WHERE (SELECT count(DISTINCT id) FROM t WHERE t.q IN (a.q, b.q)) BETWEEN 10 AND 100000")
def wl_or(spark: SparkSession, d: str) -> DataFrame:
    q = _named(spark, d)
    a, b = q.select(F.col("qid").alias("a"), F.col("q").alias("qa")), q.select(F.col("qid").alias("b"), F.col("q").alias("qb"))
    out = W.unions(_hits(spark, d), _terms(spark, d).select("qid", "field"), 10, 100000).join(a, "a").join(b, "b")
    return out.select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b"), "either")


_M = [("o_orderstatus", "F"), ("o_orderstatus", "O"), ("o_orderpriority", "1-URGENT"), ("o_orderpriority", "5-LOW")]
_MSUM = " + ".join(f"({c} = '{v}')::INT" for c, v in (_M[0], _M[2])) + " + (o_totalprice >= 200000)::INT"


@query(f"SELECT CAST(1 AS BIGINT) AS cid, CAST({_MSUM} AS BIGINT) AS matched, count(*) AS n FROM orders WHERE {_MSUM} >= 2 GROUP BY 2")
def wl_mofn(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    hits = W.evaluate_scan(o, [(10, P.eq(*_M[0])), (11, P.eq(*_M[2])), (12, P.ge("o_totalprice", 200000))], "o_orderkey").withColumn("qid", F.col("qid").cast("long"))
    combos = spark.createDataFrame([(1, 2, q) for q in (10, 11, 12)], "cid long, m int, qid long")
    return W.thresholds(combos, hits)


@query(f"SELECT o_orderkey, {_MSUM} AS score FROM orders WHERE {_MSUM} >= 1")
def wl_ranked(spark: SparkSession, d: str) -> DataFrame:
    score = P.m_of_n(1, P.eq(*_M[0]), P.eq(*_M[2]), P.ge("o_totalprice", 200000))
    return table(spark, d, "orders").select("o_orderkey", score.alias("score")).where("score >= 1").orderBy(F.desc("score"), "o_orderkey")


@query()
def w_reorder(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    hits = W.evaluate_scan(o, [(i, P.eq(*m)) for i, m in enumerate(_M)] + [(9, P.ge("o_totalprice", 200000))], "o_orderkey").withColumn("qid", F.col("qid").cast("long"))
    combos = spark.createDataFrame([(1, 0), (1, 2), (1, 9), (2, 1), (2, 3), (2, 9)], "cid long, qid long")
    return W.reorder(combos, hits)


@query("SELECT DISTINCT p_partkey AS atomic_row_id, l_orderkey AS full_row_id FROM lineitem JOIN part ON l_partkey = p_partkey")
def wl_junction(spark: SparkSession, d: str) -> DataFrame:
    full = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_list("l_partkey").alias("terms"))
    return W.junction(full)


@query("SELECT row_number() OVER (ORDER BY q) AS aqid, q AS where_clause, n AS num_matching_records, field, CASE field WHEN 'c_nationkey' THEN 'integer' ELSE 'string' END AS field_type FROM (" + _N + ")")
def wl_rows(spark: SparkSession, d: str) -> DataFrame:
    from sextant.operators.aggregates import cumulative

    counted = W.counted(_hits(spark, d)).join(_terms(spark, d), "qid").select(F.concat_ws("=", "field", "value").alias("where_clause"), F.col("n").alias("num_matching_records"), "field", F.lit(1).alias("one"))
    numbered = cumulative(counted, ["where_clause"], "one", "aqid")
    return numbered.select("aqid", "where_clause", "num_matching_records", "field", F.when(F.col("field") == "c_nationkey", "integer").otherwise("string").alias("field_type"))


@query("SELECT n.q, CASE WHEN n.n < 40 THEN 0.5 + 0.01 * m ELSE 1.0 + 0.002 * m END AS seconds FROM (SELECT *, CASE n % 3 WHEN 0 THEN n WHEN 1 THEN n // 2 ELSE n // 5 END AS m FROM (" + _N + ")) n")
def wl_cost(spark: SparkSession, d: str) -> DataFrame:
    """Costs by all matches, by those of the first term, here a half, or of the last tier, here a fifth."""
    timings = spark.createDataFrame([("x", 39, 0.5, 0.01), ("x", 100, 1.0, 0.002)], "system string, size long, fixed double, per_match double")
    basis = F.when(F.col("n") % 3 == 0, "total").when(F.col("n") % 3 == 1, "first").otherwise("last_tier")
    q = W.counted(_hits(spark, d)).join(_named(spark, d), "qid").withColumns({"system": F.lit("x"), "size": F.col("n"), "basis": basis, "n_first": F.floor(F.col("n") / 2), "n_last_tier": F.floor(F.col("n") / 5)})
    return W.cost(perf.nearest_timing(q, timings, ["system"], "size")).select("q", "seconds")


@query("""WITH RECURSIVE q AS (SELECT p_type AS category, p_size % 3 AS band, p_partkey AS qid, p_size / 10 AS seconds, row_number() OVER (PARTITION BY p_type, p_size % 3 ORDER BY p_partkey) AS i FROM part),
 r AS (SELECT category, band, qid, i, seconds AS total, 0 AS batch FROM q WHERE i = 1 UNION ALL SELECT q.category, q.band, q.qid, q.i, CASE WHEN total + seconds > 20 THEN seconds ELSE total + seconds END, batch + (total + seconds > 20)::INT
 FROM r JOIN q ON q.category = r.category AND q.band = r.band AND q.i = r.i + 1) SELECT category, band, qid, batch FROM r""")
def wl_pack(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("category"), (F.col("p_size") % 3).alias("band"), (F.col("p_size") / 10).alias("seconds"))
    return W.pack(q, ["category"], 20.0)


@query("SELECT DISTINCT l_partkey AS qid FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'SMALL' AND p_size BETWEEN 10 AND 40 AND l_partkey <> l_orderkey")
def wl_select(spark: SparkSession, d: str) -> DataFrame:
    full = table(spark, d, "part").select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("category"), F.col("p_size").alias("n"))
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("atomic_row_id"), F.col("l_orderkey").alias("full_row_id"))
    return W.select_components(full, links, "SMALL", 10, 40)


@query("SELECT 'o_totalprice' AS field, side, bound FROM (SELECT round(o_totalprice / 50000) AS bound, sum(count(*)) OVER (ORDER BY round(o_totalprice / 50000)) / (SELECT count(*) FROM orders) AS u, sum(count(*)) OVER (ORDER BY round(o_totalprice / 50000) DESC) / (SELECT count(*) FROM orders) AS v FROM orders GROUP BY 1), LATERAL (VALUES ('le', u), ('ge', v)) s(side, share) WHERE share BETWEEN 0.2 AND 0.7")
def wl_range(spark: SparkSession, d: str) -> DataFrame:
    dist = D.learn(table(spark, d, "orders").withColumn("bound", F.round(F.col("o_totalprice") / 50000)), "bound")
    return W.range_candidates(dist, "o_totalprice", "bound", 0.2, 0.7).select("field", "side", "bound")


@query()
def wl_eq(spark: SparkSession, d: str) -> DataFrame:
    return W.value_candidates(D.learn(table(spark, d, "customer"), "c_nationkey"), "c_nationkey", "c_nationkey", "EQ", 0.0, 1.0, 5, 11)


@query("SELECT category, q, aq FROM (SELECT 'delete' AS category, 'F' AS q, 'a' AS aq) WHERE false UNION ALL SELECT kind, o_orderstatus, CAST(count(*) AS VARCHAR) FROM (SELECT 'pre' AS kind, o_orderstatus FROM orders UNION ALL SELECT 'post', o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1, 2")
def wl_mods(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each status query before and after every tenth order is deleted."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    gone = o.where("id % 10 = 0").select("id", F.lit(None).cast("string").alias("o_orderstatus"), F.lit(1).alias("seq"), F.lit("delete").alias("op"))
    after = R.apply_changes(o, gone)
    counts = lambda rows, kind: rows.groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit(kind).alias("category"), F.col("o_orderstatus").alias("q"), F.col("n").cast("string").alias("aq"))
    return counts(o, "pre").union(counts(after, "post"))


# -- scoring: results with rows dropped, added and rehashed by rule ---------------------------------


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.md5("o_orderpriority").alias("hash"))


def _returned(spark: SparkSession, d: str) -> DataFrame:
    t = _truth(spark, d)
    kept = t.where("id % 7 <> 0").withColumn("hash", F.when(F.col("id") % 13 == 0, F.md5(F.lit("bad"))).otherwise(F.col("hash")))
    return kept.union(t.where("id % 17 = 0").select("qid", -F.col("id"), "hash"))


_SCORED = """SELECT o_custkey AS qid, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS tp, count(*) FILTER (WHERE o_orderkey % 17 = 0 AND o_orderkey <> 0) AS fp,
 count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey <> 0) AS fn, count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 13 = 0) AS bad_hash FROM orders WHERE o_orderkey <> 0 GROUP BY 1"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(_truth(spark, d).where("id <> 0"), _returned(spark, d).where("id <> 0"))


@query(f"SELECT qid, tp, fp, fn, bad_hash, fp > 0 OR fn > 0 OR bad_hash > 0 AS wrong FROM ({_SCORED})")
def sc_1(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query(f"SELECT qid, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 3) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 3) END AS recall, CASE WHEN tp = 0 THEN 0.0 ELSE round(bad_hash / tp, 3) END AS bad_hash_fraction FROM ({_SCORED})")
def sc_2(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rates(_scored(spark, d)).select("qid", "precision", "recall", "bad_hash_fraction")


@query("""WITH r AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
 SELECT qid, (qid % 3 = 0 AND max(n) > 2) AS badly_ranked FROM r GROUP BY 1""")
def sc_3(spark: SparkSession, d: str) -> DataFrame:
    """Every third query returns its list with the first and the last id swapped across tiers."""
    pair = F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("id"))
    truth = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda s: s["id"]).alias("ids"))
    truth = truth.withColumn("sizes", F.array(F.lit(1).cast("long"), F.lit(1).cast("long")))
    turned = F.concat(F.array(F.element_at("ids", -1)), F.slice("ids", 2, F.greatest(F.size("ids") - 2, F.lit(0))), F.array(F.element_at("ids", 1)))
    returned = truth.select("qid", F.when((F.col("qid") % 3 == 0) & (F.size("ids") > 2), turned).otherwise(F.col("ids")).alias("ids"))
    return scoring.badly_ranked(truth, returned)


@query("""SELECT count(*) FILTER (WHERE r AND s) AS right_reject, count(*) FILTER (WHERE NOT r AND NOT s) AS right_accept, count(*) FILTER (WHERE r AND NOT s) AS wrong_reject, count(*) FILTER (WHERE NOT r AND s) AS wrong_accept
 FROM (SELECT o_orderkey % 4 = 0 AS r, o_orderstatus = 'F' OR o_orderpriority = '5-LOW' AS s FROM orders WHERE o_totalprice > 5000)""")
def sc_5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(1).alias("returned"), F.when(F.col("o_totalprice") > 5000, 1).otherwise(0).alias("matching"),
        F.array("o_orderstatus", "o_orderpriority").alias("current"), F.array(F.lit("F"), F.lit("5-LOW")).alias("rejecting"),
    )
    return scoring.policy(rows)


_FRESH = """WITH e AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS s FROM events),
 m AS (SELECT event_id AS mid, user_id, s AS tm, coalesce(lag(s) OVER w, s) AS previous, coalesce(lead(s) OVER w, s) AS following FROM e WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
 q AS (SELECT event_id AS qid, user_id, s AS sent, event_id % 3 AS k FROM e WHERE event_type <> 'error'),
 v AS (SELECT mid, qid, sent - tm AS delay, CASE WHEN sent >= tm THEN CASE k WHEN 1 THEN 'good' WHEN 0 THEN 'stale' ELSE 'bad' END ELSE CASE k WHEN 0 THEN 'good' ELSE 'bad' END END AS verdict FROM m JOIN q ON m.user_id = q.user_id AND sent BETWEEN previous AND following) """


@query(_FRESH + "SELECT mid, verdict, count(*) AS n, min(delay) AS least, max(delay) AS greatest FROM v GROUP BY 1, 2")
def sc_6(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(S.micros("ts") / 1_000_000).cast("double").alias("s"))
    mods = windows.neighbours(e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("mid"), F.lit("insert").alias("category"), F.col("s").alias("at")), ["user_id"], "at", "mid")
    lists = [F.array(F.lit(i)) for i in range(3)]
    queries = e.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("qid"), F.col("s").alias("sent"), F.array((F.col("event_id") % 3).cast("int")).alias("ids"))
    fresh = scoring.freshness(mods.withColumns({"pre": lists[0], "post": lists[1]}), queries, 86400, ["user_id"])
    return fresh.groupBy("mid", "verdict").agg(F.count("*").alias("n"), F.min("delay").alias("least"), F.max("delay").alias("greatest"))


@query(_FRESH + "SELECT 'insert' AS category, min(delay) FILTER (WHERE delay >= 0 AND verdict = 'good') AS first_good, max(delay) FILTER (WHERE delay >= 0 AND verdict = 'stale') AS last_stale FROM v")
def a_arrival(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(S.micros("ts") / 1_000_000).cast("double").alias("s"))
    mods = windows.neighbours(e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("mid"), F.lit("insert").alias("category"), F.col("s").alias("at")), ["user_id"], "at", "mid")
    queries = e.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("qid"), F.col("s").alias("sent"), F.array((F.col("event_id") % 3).cast("int")).alias("ids"))
    return scoring.arrival(scoring.freshness(mods.withColumns({"pre": F.array(F.lit(0)), "post": F.array(F.lit(1))}), queries, 86400, ["user_id"]))


@query(f"""WITH s AS (SELECT s.*, c_mktsegment, c_nationkey % 2 AS half FROM ({_SCORED}) s JOIN customer ON qid = c_custkey)
 SELECT c_mktsegment, half, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(bad_hash) AS BIGINT) AS bad_hash, CAST(grouping(c_mktsegment) * 2 + grouping(half) AS BIGINT) AS level,
 CASE WHEN sum(tp) + sum(fp) = 0 THEN 1.0 ELSE round(sum(tp) / (sum(tp) + sum(fp)), 3) END AS precision, CASE WHEN sum(tp) + sum(fn) = 0 THEN 1.0 ELSE round(sum(tp) / (sum(tp) + sum(fn)), 3) END AS recall, CASE WHEN sum(tp) = 0 THEN 0.0 ELSE round(sum(bad_hash) / sum(tp), 3) END AS bad_hash_fraction
 FROM s GROUP BY CUBE (c_mktsegment, half)""")
def sc_12(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), "c_mktsegment", (F.col("c_nationkey") % 2).alias("half"))
    return scoring.merged(_scored(spark, d).join(keys, "qid"), ["c_mktsegment", "half"])


@query("SELECT o_orderpriority, count(*) AS n, round(avg((o_totalprice > 200000)::INT), 6) AS accuracy FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def sc_8(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumns({"good": F.col("o_totalprice") > 200000, "failed": F.col("o_orderstatus") == "P"})
    return scoring.accuracy(rows, ["o_orderpriority"], "good", "failed")


@query("""SELECT p_type, CASE WHEN count(*) FILTER (WHERE p_size % 2 = 0) = 0 THEN '-' WHEN bool_or(p_size > 45) FILTER (WHERE p_size % 2 = 0) THEN 'pass' ELSE 'fail' END AS even,
 CASE WHEN count(*) FILTER (WHERE p_size % 2 = 1) = 0 THEN '-' WHEN bool_or(p_size > 48) FILTER (WHERE p_size % 2 = 1) THEN 'pass' ELSE 'fail' END AS odd FROM part GROUP BY 1""")
def sc_9(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    rows = table(spark, d, "part").withColumns({"kind": F.when(even, "even").otherwise("odd"), "good": F.when(even, F.col("p_size") > 45).otherwise(F.col("p_size") > 48)})
    return scoring.support_matrix(rows, ["p_type"], "kind", "good", ["even", "odd"])


@query("SELECT event_id, CAST(event_id % 5 + 2 - (event_type = 'error')::INT - (event_id % 3 = 0)::INT AS INTEGER) AS n_new FROM events")
def sc_11(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a query with 2 to 6 matches, of which event 99 tells once or twice that one was cached."""
    events = F.array(F.when(F.col("event_type") == "error", "99").otherwise("1"), F.lit("990"), F.when(F.col("event_id") % 3 == 0, "99").otherwise("2"))
    return table(spark, d, "events").select("event_id", scoring.new_records(F.col("event_id") % 5 + 2, events).cast("int").alias("n_new"))


@query("SELECT o_custkey AS qid, CASE WHEN o_orderkey % 17 = 0 AND s = -1 THEN 'extra' ELSE 'missing' END AS status, o_orderkey * s AS id FROM orders, (VALUES (1), (-1)) t(s) WHERE o_orderkey <> 0 AND ((s = 1 AND o_orderkey % 7 = 0) OR (s = -1 AND o_orderkey % 17 = 0))")
def sc_10(spark: SparkSession, d: str) -> DataFrame:
    out = R.compare(_truth(spark, d).where("id <> 0"), _returned(spark, d).where("id <> 0"), ["qid", "id"], ["hash"])
    return out.where("status IN ('missing', 'extra')")


# -- logs -------------------------------------------------------------------------------------------


@query("SELECT user_id, string_agg(event_id::VARCHAR, '|' ORDER BY ts, event_id) AS ids, string_agg(event_type, '|' ORDER BY ts, event_id) AS kinds FROM events GROUP BY 1")
def log_6(spark: SparkSession, d: str) -> DataFrame:
    out = logs.event_lists(table(spark, d, "events"), ["user_id"], "ts", "event_id", "event_type")
    return out.select("user_id", S.to_pipes(F.transform("ids", lambda x: x.cast("string"))).alias("ids"), S.to_pipes(F.col("vals")).alias("kinds"))


@query("SELECT o_custkey AS qid, string_agg(o_orderkey::VARCHAR || ' ' || md5(o_orderpriority), '|' ORDER BY o_orderkey) AS pairs FROM orders WHERE o_orderpriority <> '' GROUP BY 1")
def log_4(spark: SparkSession, d: str) -> DataFrame:
    out = logs.aligned(_truth(spark, d), "qid", "id", "hash")
    return out.select("qid", S.to_pipes(F.zip_with("ids", "hashes", lambda a, b: F.concat_ws(" ", a.cast("string"), b))).alias("pairs"))


@query("WITH r AS (SELECT user_id AS qid, event_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error' AND event_id % 3 = 0) SELECT qid, CASE WHEN max(n) = 2 THEN min(run) END AS pre, CASE WHEN max(n) = 2 THEN max(run) END AS post, max(n) = 2 AS complete FROM r GROUP BY 1")
def log_5(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").where("event_type = 'error' AND event_id % 3 = 0").select(F.col("user_id").alias("qid"), F.col("event_id").alias("run"))
    return logs.pre_post(runs)


@query("SELECT o_orderpriority AS query, count(DISTINCT o_orderstatus) AS n_results FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def log_9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("row"))
    return logs.inconsistent(rows)


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'insert' WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'append' END AS action, count(*) AS n FROM orders GROUP BY 1")
def log_8(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), F.col("o_orderstatus").alias("result"))
    known = t.where("query % 7 <> 0")
    new = t.withColumn("result", F.when(F.col("query") % 11 == 0, "changed").otherwise(F.col("result")))
    return logs.upsert(known, new, "query", "result").groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts AS stamp, event_type AS rest FROM events")
def log_10(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("] "), "event_type").alias("value"))
    out = logs.stamped(lines)
    return out.select("event_id", F.col("stamp").cast("timestamp_ntz").alias("stamp"), "rest")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value > 200")
def log_7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("user", F.when(F.col("event_type") == "error", None).otherwise(F.col("user_id"))).withColumn("amount", F.when(F.col("value") > 200, None).otherwise(F.col("value")))
    return logs.lacking(e, ["user", "amount"]).select("event_id")


# -- publish and subscribe: events as publications ------------------------------------------------------


def _subs(spark: SparkSession, d: str) -> DataFrame:
    """Four subscriptions a customer key modulo 15: by type and user, by value, by negation, by threshold."""
    u = table(spark, d, "events").select("user_id").distinct()
    term = lambda sub, clause, k, neg, field, op, value, number, m=None: F.struct(sub.alias("sub"), F.lit(clause).alias("clause"), F.lit(k).alias("term"), F.lit(neg).alias("negated"), F.lit(field).alias("field"), F.lit(op).alias("op"), value.cast("string").alias("value"), number.cast("double").alias("number"), F.lit(m).cast("int").alias("m"))
    k, none = F.col("user_id"), F.lit(None)
    s = [k * 10 + i for i in range(4)]
    rows = [
        term(s[0], 0, 0, False, "event_type", "=", F.lit("click"), none), term(s[0], 0, 1, False, "user_id", "=", k, none), term(s[0], 1, 0, False, "value", ">=", F.lit("150"), F.lit(150)),
        term(s[1], 0, 0, False, "user_id", "=", k, none), term(s[1], 0, 1, True, "event_type", "=", F.lit("view"), none),
        term(s[2], 0, 0, False, "event_type", "=", F.lit("error"), none, 2), term(s[2], 0, 1, False, "user_id", "=", k, none, 2), term(s[2], 0, 2, False, "value", "<", F.lit("20"), F.lit(20), 2),
    ]
    return u.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_SUBS = """WITH u AS (SELECT DISTINCT user_id AS k FROM events),
 a AS (SELECT event_id AS pub, k * 10 AS sub FROM events, u WHERE (event_type = 'click' AND user_id = k) OR value >= 150
 UNION ALL SELECT event_id, k * 10 + 1 FROM events, u WHERE user_id = k AND event_type <> 'view'
 UNION ALL SELECT event_id, k * 10 + 2 FROM events, u WHERE (event_type = 'error')::INT + (user_id = k)::INT + (value < 20)::INT >= 2) """


@query(_SUBS + "SELECT pub, sub FROM a")
def ps_match(spark: SparkSession, d: str) -> DataFrame:
    return pubsub.match(table(spark, d, "events"), _subs(spark, d), "event_id", ["event_type", "user_id", "value"])


@query(_SUBS + "SELECT pub, sub FROM a JOIN events ON pub = event_id WHERE ts >= TIMESTAMP '2024-01-05' AND (sub % 20 <> 0 OR ts < TIMESTAMP '2024-01-20')")
def ps_dyn(spark: SparkSession, d: str) -> DataFrame:
    """Subscriptions begin on 5 January; those with an even key end on the 20th, by a second change each."""
    pubs, terms = table(spark, d, "events"), _subs(spark, d)
    subs = terms.select("sub").distinct()
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    changes = subs.select("sub", at("05").alias("at"), F.lit(True).alias("active")).union(subs.select("sub", at("06"), F.lit(True))).union(subs.where("sub % 20 = 0").select("sub", at("20"), F.lit(False)))
    return pubsub.match(pubs, terms, "event_id", ["event_type", "user_id", "value"], "ts", pubsub.validity(changes))


@query(_SUBS + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN pub % 9 = 0 THEN 'missing' ELSE 'right' END AS status FROM a UNION ALL SELECT 'extra' FROM a WHERE pub % 8 = 0) GROUP BY 1")
def ps_audit(spark: SparkSession, d: str) -> DataFrame:
    hits = pubsub.match(table(spark, d, "events"), _subs(spark, d), "event_id", ["event_type", "user_id", "value"])
    actual = hits.where("pub % 9 <> 0").union(hits.where("pub % 8 = 0").select("pub", -F.col("sub") - 1))
    return pubsub.audit(hits, actual).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumble(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin of the stream form, by the same function."""
    from sextant.streaming import series

    return series.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*")})


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000 THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def st_session(spark: SparkSession, d: str) -> DataFrame:
    from sextant.streaming import series

    return series.sessions(table(spark, d, "events"), "ts", 3600, ["user_id"], {"n": F.count("*")})


# -- synthetic data -----------------------------------------------------------------------------------


@query()
def dg_sample(spark: SparkSession, d: str) -> DataFrame:
    """A nation for each order, drawn from the customers' nations."""
    dist = D.learn(table(spark, d, "customer"), "c_nationkey")
    return synth.draw(table(spark, d, "orders").select("o_orderkey"), dist, "c_nationkey", "o_orderkey", 5, "nation").withColumnRenamed("nation", "drawn")


@query()
def dg_cond(spark: SparkSession, d: str) -> DataFrame:
    """A segment for each supplier, drawn given its nation."""
    dist = D.learn(table(spark, d, "customer"), "c_mktsegment", given=["c_nationkey"])
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))
    return synth.draw_given(rows, dist, ["c_nationkey"], "c_mktsegment", "s_suppkey", 5, "segment")


@query()
def dg_row(spark: SparkSession, d: str) -> DataFrame:
    """A synthetic person for each order, from the customers' distributions."""
    return synth.people(table(spark, d, "orders").select(F.col("o_orderkey").alias("seed_id")), "seed_id", 99)


@query()
def dg_text(spark: SparkSession, d: str) -> DataFrame:
    """A text for each customer from the documents' whole two-word model; a fifth have one alarm word or two."""
    docs = table(spark, d, "documents")
    model = D.next_words(docs, "doc_id", F.filter(F.split("text", " "), lambda w: w != ""))
    made = synth.texts(table(spark, d, "customer").select("c_custkey"), model, "c_custkey", 120, 3)
    return made.select("c_custkey", synth.with_alarms(F.col("text"), F.col("c_custkey"), ["FIRE", "SMOKE", "WATER"], 3).alias("text"))


@query()
def dg_xml(spark: SparkSession, d: str) -> DataFrame:
    return synth.xml(table(spark, d, "customer"), "c_custkey", [["c_name", "c_mktsegment"], ["c_nationkey"]])


@query()
def dg_xml_tree(spark: SparkSession, d: str) -> DataFrame:
    """A random tree for each customer: 25 branches, each with five fields of a synthetic person of its own."""
    # few bytes hold many customers: keys are dealt before their branches are made, and stay with their customer's
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("long")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    groups = keys.select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("g")).withColumn("seed_id", F.col("c_custkey") * 25 + F.col("g"))
    people = synth.people(groups, "seed_id", 7, ["c_custkey", "g"])
    return synth.xml_trees(people, "c_custkey", "g", [c for c in people.columns if c not in ("c_custkey", "g", "id")], 7)


# -- more workload and index forms ------------------------------------------------------------------------


@query()
def a_stemcnt(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns that contain each stem."""
    from sextant.operators import textindex

    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return textindex.stems(textindex.keywords(turns, "id", ["text"]), textindex.suffix_stem).groupBy("stem").agg(F.count("*").alias("n_rows"))


@query("SELECT c_mktsegment AS qid, min(c_nationkey) AS value, count(*) FILTER (WHERE c_nationkey = m) AS n FROM (SELECT *, min(c_nationkey) OVER (PARTITION BY c_mktsegment) AS m FROM customer) GROUP BY 1")
def wl_fish(spark: SparkSession, d: str) -> DataFrame:
    """Open equality queries, each resolved to the smallest value among its matches."""
    from sextant.operators.aggregates import fishing

    m = table(spark, d, "customer").select(F.col("c_mktsegment").alias("qid"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value"))
    return fishing(m, "value").groupBy("qid", "value").agg(F.count("*").alias("n"))


@query("SELECT a.f || '+' || b.f AS fields, round(a.s * b.s, 9) AS share FROM (SELECT 'status' AS f, 1.0 / count(DISTINCT o_orderstatus) AS s FROM orders UNION ALL SELECT 'priority', 1.0 / count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'customer', 1.0 / count(DISTINCT o_custkey) FROM orders) a, (SELECT 'status' AS f, 1.0 / count(DISTINCT o_orderstatus) AS s FROM orders UNION ALL SELECT 'priority', 1.0 / count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'customer', 1.0 / count(DISTINCT o_custkey) FROM orders) b WHERE a.f < b.f AND a.s * b.s <= 0.05")
def wl_comp(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of fields whose joint selectivity stays in a budget; a row a field, so a few rows."""
    named = {"status": "o_orderstatus", "priority": "o_orderpriority", "customer": "o_custkey"}
    counts = table(spark, d, "orders").agg(*[F.count_distinct(c).alias(f) for f, c in named.items()])
    sel = counts.select(F.explode(F.create_map(*[x for f in named for x in (F.lit(f), F.lit(1.0) / F.col(f))])).alias("f", "s"))
    a, b = sel.select(F.col("f").alias("fa"), F.col("s").alias("sa")), sel.select(F.col("f").alias("fb"), F.col("s").alias("sb"))
    return a.join(b, F.col("fa") < F.col("fb")).where("sa * sb <= 0.05").select(F.concat_ws("+", "fa", "fb").alias("fields"), F.round(F.col("sa") * F.col("sb"), 9).alias("share"))


@query("SELECT c_mktsegment, p.lo AS low, count(*) AS n FROM customer, (VALUES (0), (2000), (4000), (6000), (8000)) p(lo) WHERE c_acctbal BETWEEN lo AND lo + 2500 GROUP BY 1, 2")
def wl_ta2(spark: SparkSession, d: str) -> DataFrame:
    """Conjunctions of one equality and one range term, all at once: range hits join the equality term on the row."""
    c = table(spark, d, "customer")
    ranges = spark.createDataFrame([(k, k * 2000.0, k * 2000.0 + 2500) for k in range(5)], "qid long, low double, high double")
    hits = W.evaluate_ranges(c, ranges, "c_custkey", "c_acctbal", 1000.0)
    out = hits.join(c.select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id").groupBy("c_mktsegment", "qid").agg(F.count("*").alias("n"))
    return out.select("c_mktsegment", (F.col("qid") * 2000).cast("int").alias("low"), "n")


@query("SELECT event_type, count(*) AS n_subs, CAST(sum(hits) AS BIGINT) AS n_hits FROM (SELECT t.event_type, t.user_id, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND e.user_id = t.user_id) AS hits FROM (SELECT DISTINCT event_type, user_id FROM events) t) GROUP BY 1")
def ps_gen(spark: SparkSession, d: str) -> DataFrame:
    """Subscriptions generated from the publications' values, with their match counts."""
    e = table(spark, d, "events")
    subs = pubsub.generate(e, ["event_type", "user_id"])
    hits = pubsub.match(e, subs, "event_id", ["event_type", "user_id"]).groupBy("sub").agg(F.count("*").alias("hits"))
    kinds = subs.where("field = 'event_type'").select("sub", F.lower("value").alias("event_type"))
    return kinds.join(hits, "sub", "left").groupBy("event_type").agg(F.count("*").alias("n_subs"), F.sum(F.coalesce("hits", F.lit(0))).alias("n_hits"))


@query("""SELECT p_partkey, CASE WHEN NOT many AND c > 1 THEN c ELSE 0 END AS or_fan_in, CASE WHEN t > 1 THEN t ELSE 0 END AS and_fan_in, (t > 1)::INT + (many OR c > 1)::INT + neg::INT AS depth,
 c * t AS terms, CASE WHEN many THEN 2 ELSE 0 END AS m, CASE WHEN many THEN c ELSE 0 END AS n, NOT many AND NOT (neg AND (c > 1 OR t > 1)) AS dnf
 FROM (SELECT p_partkey, CAST(p_size % 4 + 1 AS INTEGER) AS c, CAST(p_partkey % 3 + 1 AS INTEGER) AS t, p_size % 5 = 0 AS many, p_size % 7 = 0 AS neg FROM part)""")
def fn_expr_shape(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of the WHERE texts that parts stand for: ORs or thresholds of conjunctions, some negated, with brackets and words in quotes."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fold takes about a millisecond, so few bytes are much work
    c, t = F.col("p_size") % 4 + 1, (F.col("p_partkey") % 3 + 1).cast("int")
    term = lambda j: F.concat(F.lit("upper(p_name) = 'A AND (B"), j.cast("string"), F.lit("'"))
    clauses = F.transform(F.sequence(F.lit(1), c), lambda i: F.concat(F.lit("("), F.array_join(F.transform(F.sequence(F.lit(1), t), term), " AND "), F.lit(")")))
    whole = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("M_OF_N(2, "), c.cast("string"), F.lit(", "), F.array_join(clauses, ", "), F.lit(")"))).otherwise(F.array_join(clauses, " OR "))
    text = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("NOT ("), whole, F.lit(")"))).otherwise(whole)
    return table(spark, d, "part").select("p_partkey", text.alias("w")).repartition(parts, "p_partkey").select("p_partkey", P.text_shape("w").alias("s")).select("p_partkey", "s.*")


@query()
def st_quant(spark: SparkSession, d: str) -> DataFrame:
    from sextant.streaming import series

    return series.quantiles(table(spark, d, "events"), "ts", "1 day", "value", [0.5, 0.9])
