"""Registered queries: predicates, joins, sets, order, changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import predicates as P
from sextant.functions import scalars as S
from sextant.operators import relational as R

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


@query("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
def f_eq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(P.eq("c_mktsegment", "building")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) <> 'BUILDING'")
def f_ne(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(P.ne("c_mktsegment", "Building")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def f_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(P.between("l_quantity", 10, 12)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000 UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice <= 20000")
def f_range_open(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(P.between("o_totalprice", 300000)).union(o.where(P.between("o_totalprice", None, 20000))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01'")
def f_le(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(P.le("o_orderdate", dt.datetime(1996, 6, 1))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 915")
def f_ge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.ge("p_retailprice", 915)).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 1000 > o_orderkey % 300")
def f_lambda(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(P.where(lambda price, key: price / 1000 > key % 300, "o_totalprice", "o_orderkey")).select("o_orderkey")


@query(r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(upper(text), '[^\p{L}\p{N}'']+'), 'WITH')")
def f_kw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(P.contains_word("text", "with")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE upper(p_brand) LIKE '_RAND#12'")
def f_wild1_i(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.wild_first("p_brand", "rand#12")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE upper(p_brand) LIKE 'BRAND#1_'")
def f_wild1_f(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.wild_last("p_brand", "brand#1")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE upper(o_orderpriority) LIKE '__URG__T' OR upper(o_orderpriority) LIKE '1_URGENT'")
def f_wildn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(P.any_of(P.wild("o_orderpriority", ["", "urg", "t"], 2), P.wild("o_orderpriority", ["1", "urgent"]))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE upper(p_type) LIKE 'ST_N%'")
def f_wildn_f(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.wild("p_type", ["st", "n"], more_after=True)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE upper(p_type) LIKE '%A_L'")
def f_wildn_i(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.wild("p_type", ["a", "l"], more_before=True)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE upper(p_type) LIKE '%O_O%'")
def f_wildn_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.wild("p_type", ["o", "o"], more_before=True, more_after=True, backtrack=True)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE strpos(upper(p_name), 'A') > 0 AND regexp_matches(substr(upper(p_name), strpos(upper(p_name), 'A')), '^A.V')")
def f_wildn_b_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.wild("p_name", ["a", "v"], more_before=True, more_after=True)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE upper(p_type) LIKE '%L'")
def f_sub_i(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.ends("p_type", "l")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE upper(p_name) LIKE '%AN%'")
def f_sub_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.has("p_name", "an")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE upper(p_type) LIKE 'S%'")
def f_sub_f(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.starts("p_type", "s")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE substr(c_name, 1, 9) = 'Customer#'")
def f_pfx_eq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(P.prefix("c_name") == "Customer#").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE substr(p_type, 1, 9) BETWEEN 'M' AND 'SZ'")
def f_pfx_rng(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(P.prefix("p_type").between("M", "SZ")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE upper(o_orderstatus) = 'O' AND o_totalprice BETWEEN 100000 AND 200000")
def f_and(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(P.all_of(P.eq("o_orderstatus", "o"), P.between("o_totalprice", 100000, 200000))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE upper(o_orderstatus) = 'P' OR o_totalprice >= 400000")
def f_or(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(P.any_of(P.eq("o_orderstatus", "p"), P.ge("o_totalprice", 400000))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (upper(o_orderstatus) = 'O')")
def f_not(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(P.none(P.eq("o_orderstatus", "o"))).select("o_orderkey")


_DEEP = P.Predicate("or", terms=(
    P.Predicate("and", terms=(P.Predicate("eq", "o_orderstatus", "F"), P.Predicate("or", terms=(P.Predicate("ge", "o_totalprice", 250000), P.Predicate("not", terms=(P.Predicate("starts", "o_orderpriority", "5"),)))))),
    P.Predicate("mofn", m=2, terms=(P.Predicate("eq", "o_orderstatus", "O"), P.Predicate("has", "o_orderpriority", "low"), P.Predicate("range", "o_totalprice", low=1000, high=90000))),
))


@query("""SELECT o_orderkey FROM orders WHERE (upper(o_orderstatus) = 'F' AND (o_totalprice >= 250000 OR NOT (upper(o_orderpriority) LIKE '5%')))
 OR ((upper(o_orderstatus) = 'O')::INT + (upper(o_orderpriority) LIKE '%LOW%')::INT + (o_totalprice BETWEEN 1000 AND 90000)::INT >= 2)""")
def f_deep(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(_DEEP.column()).select("o_orderkey")


_SCORE = "(CASE WHEN upper(c_mktsegment) = 'BUILDING' THEN 1 ELSE 0 END + CASE WHEN upper(o_orderstatus) = 'O' THEN 1 ELSE 0 END + CASE WHEN o_totalprice BETWEEN 100000 AND 250000 THEN 1 ELSE 0 END)"


@query(f"SELECT o_orderkey, CAST({_SCORE} AS INTEGER) AS score FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_SCORE} >= 2")
def f_mofn_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    score = P.m_of_n(2, P.eq("c_mktsegment", "building"), P.eq("o_orderstatus", "o"), P.between("o_totalprice", 100000, 250000))
    return rows.select("o_orderkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "o_orderkey")


@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j_inner(spark: SparkSession, d: str) -> DataFrame:
    edges = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    out = R.join_graph({t: table(spark, d, t) for t in ("orders", "customer", "nation", "region")}, "orders", edges, ["region", "customer"])
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT o_orderkey AS id, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def j_view(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return R.join_view(o.select("id", "o_orderstatus"), o.select("id", "o_totalprice"), o.select("id", "o_orderpriority"))


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j_alias(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("""SELECT o_orderkey, string_agg(p_brand, '|' ORDER BY l_linenumber, p_brand) AS brands, CAST(sum(p_size) AS BIGINT) AS sizes,
 CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) END AS brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey""")
def j_m2n(spark: SparkSession, d: str) -> DataFrame:
    junction = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.col("p_brand").alias("brand"))
    out = R.fold_children(table(spark, d, "orders").select("o_orderkey"), parts, junction, "o_orderkey", "p_partkey", "l_linenumber", {"p_brand": "list", "p_size": "sum", "brand": "same"})
    return out.select("o_orderkey", S.to_pipes(F.col("p_brand")).alias("brands"), F.col("p_size").alias("sizes"), "brand")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0),
 b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 5 <> 0)
 SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.v = b.v THEN 'equal' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.id = b.id""")
def j_fullcmp(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    changed = o.where("id % 5 <> 0").select("id", F.when(F.col("id") % 11 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return R.compare(o.where("id % 7 <> 0"), changed, ["id"], ["v"])


_EVENTS = "SELECT event_id, user_id, event_type, value, epoch(ts) AS s FROM events"


@query(f"""WITH e AS ({_EVENTS}), m AS (SELECT event_id AS mid, user_id, s AS at, coalesce(lag(s) OVER w, s) AS previous, coalesce(lead(s) OVER w, s) AS following FROM e WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
 SELECT mid, e.event_id FROM m JOIN e ON e.user_id = m.user_id AND e.s BETWEEN previous AND following AND event_type <> 'error'""")
def j_interval(spark: SparkSession, d: str) -> DataFrame:
    from sextant.operators.windows import neighbours

    e = table(spark, d, "events").select("event_id", "user_id", "event_type", (S.micros("ts") / 1e6).alias("s"))
    mods = neighbours(e.where("event_type = 'error'").select(F.col("event_id").alias("mid"), "user_id", F.col("s").alias("at")), ["user_id"], "at", "mid")
    return R.within(e.where("event_type <> 'error'"), mods, "s", "previous", "following", 86400, ["user_id"]).select("mid", "event_id")


@query("""WITH m AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
 SELECT event_id, coalesce((SELECT arg_max(m.value, m.ts) FROM m WHERE m.user_id = r.user_id AND m.ts <= r.ts), (SELECT arg_min(m.value, m.ts) FROM m WHERE m.user_id = r.user_id)) AS value FROM r""")
def j_asof(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return R.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select("user_id", "ts", "value"), "ts", "value", ["user_id"]).select("event_id", "value")


@query("SELECT o_orderkey, c.n_name AS customer_nation, s.n_name AS supplier_nation, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE c.n_regionkey <> 0 AND s.n_regionkey <> 0")
def j_dim(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey <> 0")  # some names are unmapped
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    a = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"))
    b = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    return rows.join(a, "c_nationkey").join(b, "s_nationkey").select("o_orderkey", "customer_nation", "supplier_nation", "l_linenumber")


@query("SELECT o_custkey AS qid, string_agg(md5(concat(o_orderstatus, o_orderpriority)), '|' ORDER BY o_orderkey) AS hashes, CAST(0 AS BIGINT) AS n_bad FROM orders GROUP BY o_custkey")
def j_hashfill(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    queries = o.groupBy(F.col("o_custkey").alias("qid")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    hashes = o.select(F.col("o_orderkey").alias("id"), S.row_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("hash"))
    return R.fill_hashes(queries, hashes).select("qid", S.to_pipes(F.col("hashes")).alias("hashes"), "n_bad")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_inter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def set_distinct(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_sorted(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"o_orderstatus": ["P", "O", "F"]})


@query("SELECT p_partkey, p_type, p_size FROM part")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(R.ranked("p_type", ["STANDARD", "SMALL", "PROMO"]), F.desc("p_size"), "p_partkey").select("p_partkey", "p_type", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def lim_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a report: the limit is the feature."""
    return R.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


@query()
def sample_one(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_one(table(spark, d, "orders"), "o_custkey", "o_orderkey", 7).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_orderpriority IS NOT NULL AND o_orderpriority <> '') AND o_totalprice > 1000")
def filter_constr(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("named", (F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "")))
    return R.constrained(o, {"o_orderstatus": "O", "named": True}, [F.col("o_totalprice") > 1000]).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def mut_update(spark: SparkSession, d: str) -> DataFrame:
    return R.update(table(spark, d, "customer"), "c_mktsegment", F.lit("DEBT"), F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 = 0""")
def mut_row(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    deleted = o.where("id % 3 = 0").select("id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("price"), F.lit(1).alias("seq"), F.lit("delete").alias("op"))
    first = o.where("id % 3 = 1").select("id", F.lit("Y").alias("status"), F.lit(5.0).alias("price"), F.lit(1).alias("seq"), F.lit("update").alias("op"))
    updated = o.where("id % 3 = 1").select("id", F.lit("X").alias("status"), F.lit(0.0).alias("price"), F.lit(2).alias("seq"), F.lit("update").alias("op"))
    inserted = o.where("id % 4 = 0").select((F.col("id") + 1000000000).alias("id"), "status", "price", F.lit(3).alias("seq"), F.lit("insert").alias("op"))
    return R.apply_changes(o, deleted.union(first).union(updated).union(inserted))


@query("SELECT k.l_partkey AS id, count(p_partkey) = 1 AS verified FROM (SELECT DISTINCT l_partkey FROM lineitem UNION SELECT -l_partkey FROM lineitem) k LEFT JOIN part ON k.l_partkey = p_partkey GROUP BY k.l_partkey")
def mut_verify(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "lineitem").select(F.explode(F.array("l_partkey", -F.col("l_partkey"))).alias("id"))
    return R.verify(asked, table(spark, d, "part").select(F.col("p_partkey").alias("id")))
