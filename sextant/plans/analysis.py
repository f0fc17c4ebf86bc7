"""Registered queries: aggregates, windows, functions, distributions, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import predicates as P
from sextant.functions import scalars as S
from sextant.operators import aggregates as A
from sextant.operators import distributions as D
from sextant.operators import perf, windows
from sextant.operators import textindex as X

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


# -- aggregates -------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem")
def a_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def a_eqcnt(spark: SparkSession, d: str) -> DataFrame:
    return A.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT l_quantity, n, CAST(sum(n) OVER (ORDER BY l_quantity) AS BIGINT) AS up_to, CAST(sum(n) OVER (ORDER BY l_quantity DESC) AS BIGINT) AS n_from FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)")
def a_rngcnt(spark: SparkSession, d: str) -> DataFrame:
    return A.running(A.value_counts(table(spark, d, "lineitem"), "l_quantity"), "l_quantity")


@query(r"SELECT word, count(*) AS n_rows FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(replace(upper(text), 'ẞ', 'SS'), '[^\p{L}\p{N}'']+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def a_kwcnt(spark: SparkSession, d: str) -> DataFrame:
    return A.word_counts(table(spark, d, "documents"), "doc_id", "text", F.upper)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE upper(o_orderpriority) = '1-URGENT'")
def a_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(P.eq("o_orderpriority", "1-urgent")).select("o_custkey", "o_orderkey")


@query("""SELECT qid, count(*) AS n, count(*) <= 12 AS valid, CASE WHEN count(*) <= 12 THEN string_agg(id::VARCHAR, '|' ORDER BY id) ELSE '' END AS ids FROM (SELECT o_custkey AS qid, o_orderkey AS id FROM orders) GROUP BY qid""")
def a_idscap(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"))
    return A.capped_ids(m, 12).select("qid", "n", "valid", S.to_pipes(F.transform("ids", lambda x: x.cast("string"))).alias("ids"))


@query("SELECT o_custkey AS qid, o_orderkey AS id, o_orderdate AS day FROM orders o WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def a_fish(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    return A.fishing(m, "day")


@query("SELECT o_orderkey, (upper(o_orderstatus) = 'F') AS t1, (o_totalprice >= 200000) AS t2 FROM orders WHERE upper(o_orderstatus) = 'F' OR o_totalprice >= 200000")
def a_boolids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"t1": P.eq("o_orderstatus", "f"), "t2": P.ge("o_totalprice", 200000)})
    return o.where(F.col("t1") | F.col("t2")).select("o_orderkey", "t1", "t2")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS weight, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a_marg(spark: SparkSession, d: str) -> DataFrame:
    return A.marginals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std, round(min(value), 3) AS least, round(max(value), 3) AS greatest FROM events GROUP BY 1")
def a_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(table(spark, d, "events"), "value", ["event_type"])


@query("SELECT p_size % 5 AS n, p_size % 3 AS m, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1, 2")
def a_meancell(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy((F.col("p_size") % 5).alias("n"), (F.col("p_size") % 3).alias("m")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"))


_PCT = "SELECT event_type, p::INTEGER AS p, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events{where}), range(1, 101) t(p) WHERE r = (p * n + 99) // 100"


@query(_PCT.format(where=""))
def a_pct100(spark: SparkSession, d: str) -> DataFrame:
    return A.percentiles(table(spark, d, "events"), "value", ["event_type"])


@query("SELECT l_returnflag, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS status FROM lineitem GROUP BY 1")
def a_firsteq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(A.all_equal("l_linestatus").alias("status"))


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS per_second FROM events GROUP BY 1, 2 HAVING max(ts) > min(ts)")
def a_rate(spark: SparkSession, d: str) -> DataFrame:
    return A.rate(table(spark, d, "events"), ["user_id", "event_type"], "ts", "ts").where("per_second is not null").withColumn("per_second", F.round("per_second", 9))


@query()
def a_aquant(spark: SparkSession, d: str) -> DataFrame:
    return A.approximate(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], [0, 0.25, 0.5, 0.9, 1])


# -- windows ----------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, weight, CAST(sum(weight) OVER (ORDER BY upper(o_orderpriority)) AS BIGINT) AS cum_weight, CAST(sum(weight) OVER () AS BIGINT) AS total FROM (SELECT o_orderpriority, count(*) AS weight FROM orders GROUP BY 1)")
def w_cdf(spark: SparkSession, d: str) -> DataFrame:
    return D.cdf(D.learn(table(spark, d, "orders"), "o_orderpriority"), "o_orderpriority")


@query("SELECT p_size, weight, CAST(sum(weight) OVER (ORDER BY weight, p_size) AS BIGINT) AS cum_weight, CAST(sum(weight) OVER () AS BIGINT) AS total FROM (SELECT p_size, count(*) AS weight FROM part GROUP BY 1)")
def w_cdf_weight(spark: SparkSession, d: str) -> DataFrame:
    return D.cdf(D.learn(table(spark, d, "part"), "p_size"), "p_size", by_weight=True)


@query("SELECT event_id, coalesce(lag(ts) OVER w, ts) AS previous, coalesce(lead(ts) OVER w, ts) AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w_prevnext(spark: SparkSession, d: str) -> DataFrame:
    return windows.neighbours(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", "previous", "following")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 7200000000 THEN 1 ELSE 0 END AS f FROM events),
 s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
 SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n, CAST(sum(CASE WHEN event_type = 'click' THEN value::DECIMAL(18,2) ELSE 0 END) AS DOUBLE) AS clicked FROM s GROUP BY 1, 2""")
def w_gapsess(spark: SparkSession, d: str) -> DataFrame:
    clicked = F.sum(F.when(F.col("event_type") == "click", F.col("value").cast("decimal(18,2)")).otherwise(0)).cast("double")
    return windows.gap_sessions(table(spark, d, "events"), ["user_id"], "ts", 7200, {"clicked": clicked})


@query("""WITH e AS (SELECT event_id, user_id, epoch(ts) AS l, CASE WHEN event_type = 'error' THEN epoch(ts) + value END AS s FROM events),
 m AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN s - l END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS o,
 first_value(CASE WHEN s IS NOT NULL THEN s - l END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f, coalesce(l < lag(l) OVER (PARTITION BY user_id ORDER BY event_id), false) AS backwards FROM e)
 SELECT event_id, round(l + coalesce(o, f), 3) AS true_time, backwards FROM m""")
def w_clock(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", (S.micros("ts") / 1e6).alias("l"), F.when(F.col("event_type") == "error", S.micros("ts") / 1e6 + F.col("value")).alias("s"))
    return windows.clock(e, ["user_id"], "event_id", "l", "s").select("event_id", F.round("true_time", 3).alias("true_time"), "backwards")


@query("""WITH b AS (SELECT event_type, CAST(epoch_us(ts) // 21600000000 AS BIGINT) AS bin, sum(value::DECIMAL(18,2)) AS total FROM events GROUP BY 1, 2),
 s AS (SELECT event_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1)
 SELECT s.event_type, s.bin, CAST(coalesce(total, 0) AS DOUBLE) AS total FROM s LEFT JOIN b ON s.event_type = b.event_type AND s.bin = b.bin""")
def w_bin(spark: SparkSession, d: str) -> DataFrame:
    return windows.bins(table(spark, d, "events"), "ts", 21600, ["event_type"], "value")


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6, 6) AS elapsed FROM events")
def w_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return windows.elapsed(table(spark, d, "events"), ["user_id"], "ts").select("event_id", F.round("elapsed", 6).alias("elapsed"))


@query("SELECT o_custkey, n, (n < 12 AND sum(CASE WHEN n < 12 THEN 1 ELSE 0 END) OVER (ORDER BY o_custkey) % 5 = 0) AS star FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def w_everyx(spark: SparkSession, d: str) -> DataFrame:
    return windows.every_nth(A.value_counts(table(spark, d, "orders"), "o_custkey"), "o_custkey", "n", 12)


@query("""WITH r AS (SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders)
 SELECT qid, CAST(CASE WHEN pos < 2 THEN 0 WHEN pos < 5 THEN 1 ELSE 2 END AS INTEGER) AS tier, id FROM r""")
def w_rankseg(spark: SparkSession, d: str) -> DataFrame:
    pair = F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("id"))
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(pair)), lambda s: s["id"]).alias("ids"))
    return windows.tiers("ids", "sizes", "qid", lists.withColumn("sizes", F.array(F.lit(2).cast("long"), F.lit(3).cast("long"))))


# -- scalar functions -------------------------------------------------------------------------------


@query(r"""SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS tokens FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[ .,!?;"-]+')) AS w FROM documents) WHERE w NOT IN ('', 'the', 'of', 'and') GROUP BY 1""")
def fn_tok(spark: SparkSession, d: str) -> DataFrame:
    toks = S.tokens(F.col("text"), ["the", "of", "and"])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(toks), " ").alias("tokens")).where("tokens <> ''")


_AT = "strpos(upper(text), ' {} ')"
_A, _B = _AT.format("THE"), _AT.format("WITH")


@query(f"SELECT doc_id, CAST(CASE WHEN {_A} < {_B} THEN {_B} - {_A} - 3 ELSE {_A} - {_B} - 4 END AS INTEGER) AS distance FROM documents WHERE {_A} > 0 AND {_B} > 0")
def fn_prox(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.proximity(F.col("text"), "the", "with").alias("distance")).where("distance is not null")


@query("SELECT n_nationkey, upper(r_name) AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def fn_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.upper("r_name").alias("label"))


@query("SELECT c_custkey, lower(hex(c_name)) AS h FROM customer")
def fn_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.hex_text(F.col("c_name")).alias("h"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS shown FROM events")
def fn_epoch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.floor(S.micros("ts") / 1e6).cast("long").alias("seconds"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("shown"))


@query("SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fn_lat(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", S.latency(S.micros("o_orderdate"), S.micros("l_shipdate")).alias("us")).select("l_orderkey", "l_linenumber", (F.col("us") / 86400000000).cast("long").alias("days"))


@query("SELECT p_partkey, (p_size >= 10 AND p_size < 20) AS inside FROM part")
def fn_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.in_band(F.col("p_size"), 10, 20).alias("inside"))


@query("SELECT p_partkey, make_date(2013 - p_size, 1, 1) - CAST(p_partkey % 366 AS INTEGER) AS dob FROM part")
def fn_dob(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.birth_date(F.col("p_size"), (F.col("p_partkey") % 366).cast("int")).alias("dob"))


@query("SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS pipes, count(*) AS n FROM orders GROUP BY 1")
def fn_pipe(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"]).alias("x"))
    text = lists.select("o_custkey", S.to_pipes(F.col("x")).alias("pipes"))
    return text.withColumn("n", F.size(S.from_pipes(F.concat(F.lit("|"), "pipes", F.lit("||")))).cast("long"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN NULL ELSE true END AS flag FROM orders")
def fn_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "O", "None").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", S.normal_bool(raw).alias("flag"))


@query("SELECT event_id, t AS event_type, u AS props FROM (SELECT event_id, unnest([event_type, 'any']) AS t FROM events) JOIN (SELECT event_id AS e, unnest(['x', 'y']) AS u FROM events) ON event_id = e")
def fn_multiv(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("["), "event_type", F.lit(",any]")).alias("event_type"), F.lit("[x,y]").alias("props"))
    return S.expand(e, ["event_type", "props"])


@query("SELECT event_type, printf('%.2f', avg(value::DECIMAL(18,2))) AS shown FROM events GROUP BY 1")
def fn_mode_fmt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(S.shown(F.avg("value"), 2).alias("shown"))


@query("SELECT c_custkey AS id, md5(concat(c_name, c_nationkey::VARCHAR, c_mktsegment)) AS hash FROM customer")
def hash_1(spark: SparkSession, d: str) -> DataFrame:
    return X.row_hashes(table(spark, d, "customer").withColumnRenamed("c_custkey", "id"), "id", [F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")])


# -- text index -------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT doc_id, 'text' AS col, w AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ .,!?;"-]+')) AS w FROM documents) WHERE w <> ''""")
def idx_1(spark: SparkSession, d: str) -> DataFrame:
    return X.keywords(table(spark, d, "documents"), "doc_id", ["text"])


@query()
def idx_2(spark: SparkSession, d: str) -> DataFrame:
    words = X.keywords(table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", ["text"])
    return X.stems(words, X.suffix_stem)


_P = {w: f"strpos(upper(text), ' {w} ')" for w in ("THE", "AND", "WITH")}
_PAIRS = [("AND", "THE"), ("AND", "WITH"), ("THE", "WITH")]


@query(" UNION ALL ".join(f"SELECT doc_id, '{a}' AS word1, '{b}' AS word2, 'text' AS field, CAST(CASE WHEN {_P[a]} < {_P[b]} THEN {_P[b]} - {_P[a]} - {len(a)} ELSE {_P[a]} - {_P[b]} - {len(b)} END AS INTEGER) AS distance FROM documents WHERE {_P[a]} > 0 AND {_P[b]} > 0 AND {_P[({'AND', 'THE', 'WITH'} - {a, b}).pop()]} = 0" for a, b in _PAIRS))
def idx_3(spark: SparkSession, d: str) -> DataFrame:
    return X.alarms(table(spark, d, "documents"), "doc_id", ["text"], ["the", "and", "with"])


def _xml(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<xml><who><name>"), "c_name", F.lit("</name><segment>"), "c_mktsegment", F.lit("</segment></who><nation>"), F.col("c_nationkey").cast("string"), F.lit("</nation></xml>"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), body.alias("xml"))


@query("SELECT c_custkey AS id, 'xml' AS field, p.path, p.rootless, p.tag, p.value FROM customer, LATERAL (VALUES ('/xml/who/name', '/who/name', 'name', c_name), ('/xml/who/segment', '/who/segment', 'segment', c_mktsegment), ('/xml/nation', '/nation', 'nation', c_nationkey::VARCHAR)) p(path, rootless, tag, value)")
def idx_4(spark: SparkSession, d: str) -> DataFrame:
    return X.xml_paths(_xml(spark, d), "id", "xml")


@query("SELECT o_orderkey, md5(concat(o_orderstatus, o_orderpriority, o_custkey::VARCHAR)) AS hash FROM orders")
def idx_5(spark: SparkSession, d: str) -> DataFrame:
    return X.row_hashes(table(spark, d, "orders"), "o_orderkey", [F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")])


@query(r"""SELECT doc_id, lang FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[ .,!?;"-]+'), 'from')""")
def j_index(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return X.search(docs, X.keywords(docs, "doc_id", ["text"]), "doc_id", "text", "from").select("doc_id", "lang")


@query()
def f_stem(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.search(docs, X.stems(X.keywords(docs, "id", ["text"]), X.suffix_stem), "id", "text", X.suffix_stem("worthless"), "stem").select("id")


@query("WITH x AS (" + SQL["idx_3"] + ") SELECT doc_id, distance FROM x WHERE word1 = 'THE' AND word2 = 'WITH' AND distance <= 400")
def f_prox(spark: SparkSession, d: str) -> DataFrame:
    index = X.alarms(table(spark, d, "documents"), "doc_id", ["text"], ["the", "and", "with"])
    return X.near_keys(index, "doc_id", "text", "with", "the", lambda x: x <= 400).orderBy("distance", "doc_id")


@query("WITH x AS (" + SQL["idx_3"] + ") SELECT word1, word2, distance, count(*) AS n FROM x GROUP BY 1, 2, 3")
def a_proxids(spark: SparkSession, d: str) -> DataFrame:
    rows = X.alarms(table(spark, d, "documents"), "doc_id", ["text"], ["the", "and", "with"])
    return rows.groupBy("word1", "word2", "distance").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
def f_xml_leaf(spark: SparkSession, d: str) -> DataFrame:
    rows = _xml(spark, d)
    return X.xml_leaf(rows, X.xml_paths(rows, "id", "xml"), "id", "segment", "building").select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 7")
def f_xml_path(spark: SparkSession, d: str) -> DataFrame:
    rows = _xml(spark, d)
    return X.xml_path(rows, X.xml_paths(rows, "id", "xml"), "id", "/xml/nation", "7").select("id")


@query("SELECT c_custkey AS id, upper(c_mktsegment) = 'BUILDING' AS building FROM customer")
def f_xpath(spark: SparkSession, d: str) -> DataFrame:
    return _xml(spark, d).where(P.xpath_exists("xml", "/xml/who/name")).select("id", P.xpath_equals("xml", "//segment", "building").alias("building"))


# -- distributions ----------------------------------------------------------------------------------


@query("SELECT c_mktsegment, c_nationkey, count(*) AS weight FROM customer GROUP BY 1, 2")
def dl_cond(spark: SparkSession, d: str) -> DataFrame:
    return D.learn(table(spark, d, "customer"), "c_nationkey", given=["c_mktsegment"])


@query("SELECT c_nationkey, count(*) AS weight FROM customer GROUP BY 1")
def dl_ind(spark: SparkSession, d: str) -> DataFrame:
    return D.top_level(D.learn(table(spark, d, "customer"), "c_nationkey", given=["c_mktsegment"]), "c_nationkey").withColumn("weight", F.col("weight").cast("long"))


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, count(*) AS weight FROM orders GROUP BY 1")
def dl_remap(spark: SparkSession, d: str) -> DataFrame:
    return D.remap(D.learn(table(spark, d, "orders"), "o_orderstatus"), "o_orderstatus", "P", "O")


@query("SELECT DISTINCT p_type FROM part")
def dl_support(spark: SparkSession, d: str) -> DataFrame:
    return D.support(D.learn(table(spark, d, "part"), "p_type"), "p_type")


@query("SELECT CAST(sum(p_size) AS BIGINT) AS weight FROM part")
def dl_size(spark: SparkSession, d: str) -> DataFrame:
    return D.size(D.learn(table(spark, d, "part"), "p_type", F.col("p_size")))


@query("SELECT 'text' AS \"column\", count(*) FILTER (WHERE contains(text, '|') OR contains(text, '\"')) AS n_bad FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE contains(source, '|')) FROM documents")
def dl_sanitise(spark: SparkSession, d: str) -> DataFrame:
    return D.forbidden(table(spark, d, "documents"), ["text", "source"])


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM t)
 SELECT coalesce(CASE WHEN k > 2 THEN w[k - 2] END, '') AS first, coalesce(CASE WHEN k > 1 THEN w[k - 1] END, '') AS second, w[k] AS following, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def dl_text(spark: SparkSession, d: str) -> DataFrame:
    return D.next_words(table(spark, d, "documents"), "doc_id", F.filter(F.split("text", " "), lambda w: w != ""))


_CDF = "SELECT p_size, n AS weight, sum(n) OVER (ORDER BY p_size) AS c, sum(n) OVER () AS t FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)"


@query(f"SELECT p_size FROM ({_CDF}) WHERE weight / t BETWEEN 0.01 AND 0.025")
def wl_pdf(spark: SparkSession, d: str) -> DataFrame:
    return D.in_share(D.cdf(D.learn(table(spark, d, "part"), "p_size"), "p_size"), 0.01, 0.025).select("p_size")


@query(f"SELECT p_size FROM ({_CDF}) WHERE c / t BETWEEN 0.1 AND 0.4")
def wl_le(spark: SparkSession, d: str) -> DataFrame:
    return D.upper_bounds(D.cdf(D.learn(table(spark, d, "part"), "p_size"), "p_size"), 0.1, 0.4).select("p_size")


@query(f"SELECT p_size FROM ({_CDF}) WHERE (t - c + weight) / t BETWEEN 0.1 AND 0.4")
def wl_ge(spark: SparkSession, d: str) -> DataFrame:
    return D.lower_bounds(D.cdf(D.learn(table(spark, d, "part"), "p_size"), "p_size"), 0.1, 0.4).select("p_size")


# -- performance ------------------------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('click', 'view')")
    a = e.select(F.col("event_id").alias("k"), "event_type", F.col("value").alias("v"))
    return perf.both_percentiles(a, e.select(F.col("event_id").alias("k"), "event_type", (F.col("value") / 2 + 1).alias("v")), "k", "v", ["event_type"])


_BOTH = "WITH c AS (" + _PCT.format(where=" WHERE event_type IN ('click', 'view')") + "), x AS (SELECT event_type, p, value AS cand, value / 2 + 1 AS base FROM c) "


@query(_BOTH + "SELECT event_type, p, cand, base, cand <= 8.0 + 5.0 * base AS met FROM x")
def pf_1(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).withColumn("met", perf.met(F.col("cand"), F.col("base"), 8, 5))


@query(_BOTH + "SELECT event_type, a::INTEGER AS a, b::INTEGER AS b, count(*) FILTER (WHERE cand <= a + b * base) AS n_met, min(p) FILTER (WHERE cand <= a + b * base) AS least_met, max(p) FILTER (WHERE cand <= a + b * base) AS greatest_met, CASE WHEN count(*) FILTER (WHERE cand <= a + b * base) = 100 THEN 'green' WHEN count(*) FILTER (WHERE cand <= a + b * base) > 0 THEN 'yellow' ELSE 'red' END AS colour FROM x, range(0, 16) ta(a), range(1, 11) tb(b) GROUP BY 1, 2, 3")
def pf_2(spark: SparkSession, d: str) -> DataFrame:
    return perf.grid(_points(spark, d), ["event_type"])


@query(_BOTH + "SELECT event_type, bool_and(cand <= 10 * base + 15) AS holds FROM x GROUP BY 1")
def pf_3(spark: SparkSession, d: str) -> DataFrame:
    return perf.holds(_points(spark, d), perf.tenfold, ["event_type"])


@query(_BOTH + "SELECT event_type, round(avg(cand / base), 9) AS mean_ratio FROM x GROUP BY 1")
def pf_4(spark: SparkSession, d: str) -> DataFrame:
    return perf.ratios(_points(spark, d), ["event_type"]).withColumn("mean_ratio", F.round("mean_ratio", 9))


@query("SELECT p::INTEGER AS p, value FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM (SELECT l_quantity + l_discount + l_tax AS value FROM lineitem)), range(1, 101) t(p) WHERE r = (p * n + 99) // 100")
def pf_5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") + F.col("l_discount") + F.col("l_tax")).alias("v"), F.lit(1).alias("all"))
    return A.percentiles(rows, "v", ["all"]).select("p", "value")


_LINE = "SELECT {by}count(*) AS n, round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 6) AS intercept, round(regr_r2({y}, {x}), 3) AS r2 FROM {t} GROUP BY {g} HAVING count(*) >= 3 AND min({x}) < max({x}) AND min({y}) < max({y})"


@query(_LINE.format(by="l_returnflag, ", y="l_extendedprice", x="l_quantity", t="lineitem", g="l_returnflag"))
def pf_6(spark: SparkSession, d: str) -> DataFrame:
    return perf.line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).where("slope is not null")


@query(_LINE.format(by="l_linenumber, l_linestatus, ", y="l_extendedprice", x="l_quantity", t="lineitem", g="l_linenumber, l_linestatus"))
def pf_7(spark: SparkSession, d: str) -> DataFrame:
    return perf.line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_linenumber", "l_linestatus"]).where("slope is not null")


@query("SELECT lang, count(*) AS n, round(regr_slope(n_chars, length(source)), 6) AS slope, round(regr_intercept(n_chars, length(source)), 6) AS intercept, round(regr_r2(n_chars, length(source)), 3) AS r2 FROM documents GROUP BY lang HAVING count(*) >= 3 AND min(length(source)) < max(length(source)) AND min(n_chars) < max(n_chars)")
def pf_8(spark: SparkSession, d: str) -> DataFrame:
    return perf.line(table(spark, d, "documents").withColumn("keyword_len", F.length("source")), "keyword_len", "n_chars", ["lang"]).where("slope is not null")


@query("SELECT p_type, count(*) AS n, round(avg(p_retailprice / p_size), 3) AS mean, round(stddev_pop(p_retailprice / p_size), 3) AS std, round(min(p_retailprice / p_size), 3) AS least, round(max(p_retailprice / p_size), 3) AS greatest FROM part GROUP BY 1")
def pf_9(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(table(spark, d, "part").withColumn("per_gate", F.col("p_retailprice") / F.col("p_size")), "per_gate", ["p_type"])


@query("SELECT event_type, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, CAST(sum(value::DECIMAL(18,2)) AS DOUBLE) AS total FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2")
def pf_10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'error' AND ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00'")
    return e.groupBy("event_type", F.floor(S.micros("ts") / 3_600_000_000).alias("hour")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT event_id, value FROM events WHERE value > 100")
def pf_11(spark: SparkSession, d: str) -> DataFrame:
    return perf.warnings(table(spark, d, "events"), "value", 100).select("event_id", "value")


@query("SELECT l_linestatus, count(*) AS n, round(avg(l_tax), 3) AS mean, round(stddev_pop(l_tax), 3) AS std, round(min(l_tax), 3) AS least, round(max(l_tax), 3) AS greatest FROM lineitem GROUP BY 1")
def pf_12(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(table(spark, d, "lineitem"), "l_tax", ["l_linestatus"])


@query("""SELECT p_brand, records, size FROM (SELECT DISTINCT p_brand, p_size AS records, CAST(p_partkey % 3 AS INTEGER) AS size FROM part)
 ORDER BY CASE WHEN records = 30 AND size = 2 THEN 1 WHEN records = 25 AND size = 1 THEN 2 ELSE 3 END, records DESC, size DESC, p_brand LIMIT 1""")
def pf_13(spark: SparkSession, d: str) -> DataFrame:
    """The one main database, of the sizes preferred in turn (the first is never there): the limit is the feature."""
    rows = table(spark, d, "part").select("p_brand", F.col("p_size").alias("records"), (F.col("p_partkey") % 3).cast("int").alias("size"))
    return perf.main_database(rows, "p_brand", "records", "size", [(-1, -1), (30, 2), (25, 1)])
