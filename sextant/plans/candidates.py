"""Registered queries: candidate queries of a wanted size, and combinations of their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import candidates as C
from sextant.operators import combine, textindex
from sextant.operators import workload as W

from . import analysis
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


# -- conjunctions and unions of three terms: status, priority, year and price band of the orders --------------

_FIELDS = ["o_orderstatus", "o_orderpriority", "year", "band"]
_LONG = """t AS (SELECT o_orderkey AS id, unnest(['o_orderstatus', 'o_orderpriority', 'year', 'band']) AS field,
 unnest([o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR), CAST(CAST(floor(o_totalprice / 100000) AS INTEGER) AS VARCHAR)]) AS v FROM orders),
 q AS (SELECT id, field, field || '=' || v AS q FROM t), n AS (SELECT q, min(field) AS field, count(*) AS n FROM q GROUP BY 1)"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.withColumn("year", F.year("o_orderdate")).withColumn("band", F.floor(F.col("o_totalprice") / 100000).cast("int"))


def _order_terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(qid, field, q) of all equality terms, their matches (qid, id), and the matches' rows."""
    cells = W.cells(_orders(spark, d), "o_orderkey", _FIELDS)
    named = F.concat_ws("=", "field", "value")
    terms = cells.select("field", named.alias("q")).distinct().withColumn("qid", F.crc32("q"))
    return terms, cells.select(F.crc32(named).alias("qid"), "id"), cells


def _shown(found: DataFrame, terms: DataFrame) -> DataFrame:
    """``found`` with the texts of its terms, sorted, in one column."""
    keyed = found.withColumn("cid", F.xxhash64(F.array_join(F.transform("terms", lambda x: x.cast("string")), ",")))
    names = keyed.select("cid", F.explode("terms").alias("qid")).join(terms.select("qid", "q"), "qid").groupBy("cid").agg(F.array_join(F.sort_array(F.collect_list("q")), " AND ").alias("q"))
    return keyed.join(names, "cid")


@query(f"""WITH {_LONG}, f AS (SELECT q FROM n WHERE n BETWEEN (SELECT count(*) // 20 FROM orders) AND (SELECT count(*) // 3 FROM orders)),
 c AS (SELECT a.q AS qa, b.q AS qb, c.q AS qc, count(*) AS n FROM q a JOIN q b ON a.id = b.id AND a.q < b.q AND a.field <> b.field JOIN q c ON a.id = c.id AND b.q < c.q AND c.field NOT IN (a.field, b.field) GROUP BY 1, 2, 3)
 SELECT qa || ' AND ' || qb || ' AND ' || qc AS q, (SELECT min(n.n) FROM n JOIN f USING (q) WHERE n.q IN (qa, qb, qc)) AS n_first, n FROM c WHERE n BETWEEN 3 AND 400 AND (qa IN (FROM f) OR qb IN (FROM f) OR qc IN (FROM f))""")
def wl_and_n(spark: SparkSession, d: str) -> DataFrame:
    """All conjunctions of three terms with 3 to 400 rows, by their first term between a twentieth and a third of the rows."""
    terms, hits, _ = _order_terms(spark, d)
    n = table(spark, d, "orders").count()
    return _shown(combine.conjunctions(hits, terms, 3, 3, 400, n // 20, n // 3), terms).select("q", "n_first", "n")


@query(f"""WITH {_LONG}, c AS (SELECT a.q AS qa, b.q AS qb, c.q AS qc, a.n + b.n + c.n AS s FROM n a JOIN n b ON a.q < b.q AND a.field <> b.field JOIN n c ON b.q < c.q AND c.field NOT IN (a.field, b.field)),
 e AS (SELECT qa, qb, qc, s, (SELECT count(DISTINCT id) FROM q WHERE q IN (qa, qb, qc)) AS n FROM c)
 SELECT qa || ' AND ' || qb || ' AND ' || qc AS q, s AS n_sum, n FROM e WHERE n BETWEEN (SELECT count(*) // 4 FROM orders) AND (SELECT count(*) // 2 FROM orders) AND s <= (SELECT count(*) * 6 // 10 FROM orders)""")
def wl_or_n(spark: SparkSession, d: str) -> DataFrame:
    """All unions of three terms with a quarter to a half of the rows, whose counts add up to six tenths at most."""
    terms, hits, _ = _order_terms(spark, d)
    n = table(spark, d, "orders").count()
    return _shown(combine.unions(hits, terms, 3, n // 4, n // 2, 0, n * 6 // 10), terms).select("q", "n_sum", "n")


# -- patterns, words, XML, proximity --------------------------------------------------------------------------

_V = "v AS (SELECT upper(c_name) AS v, count(*) AS n FROM customer GROUP BY 1)"


@query(f"""WITH {_V}, f AS (
 SELECT 'final-one' AS sub_category, left(v, length(v) - 1) || '_' AS p FROM v UNION SELECT 'initial-one', '_' || substr(v, 2) FROM v
 UNION SELECT 'middle-one', left(v, i - 1) || '_' || substr(v, i + 1) FROM v, LATERAL (SELECT unnest(range(5, length(v) - 3)) AS i) WHERE length(v) >= 9
 UNION SELECT 'final', left(v, k) || '%' FROM v, (VALUES (4), (17)) l(k) UNION SELECT 'initial', '%' || right(v, k) FROM v, (VALUES (4), (17)) l(k)
 UNION SELECT 'both', '%' || substr(v, i, k) || '%' FROM v, (VALUES (4), (17)) l(k), LATERAL (SELECT unnest(range(1, length(v) - k + 2)) AS i))
 SELECT sub_category, 'upper(c_name) LIKE ''' || p || '''' AS "where", CAST((SELECT sum(n) FROM v WHERE v LIKE p) AS BIGINT) AS n FROM f WHERE (SELECT sum(n) FROM v WHERE v LIKE p) BETWEEN 2 AND 60""")
def wl_wild(spark: SparkSession, d: str) -> DataFrame:
    """Every pattern of the customers' names that 2 to 60 of them match."""
    return C.wildcard_candidates(table(spark, d, "customer"), "c_name", [4, 17], 2, 60).select("sub_category", "where", "n")


@query(
    r"""SELECT 'CONTAINED_IN(text, ''' || replace(w, '''', '''''') || ''')' AS "where", count(*) AS n
 FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(upper(text), '[^\p{L}\p{N}'']+'))) AS w FROM documents WHERE lang = 'en') WHERE length(w) = 7 GROUP BY w HAVING count(*) BETWEEN 5 AND 50"""
)
def wl_kw(spark: SparkSession, d: str) -> DataFrame:
    """Every word of seven letters that 5 to 50 English documents contain."""
    return C.keyword_candidates(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "text", 7, 5, 50).select("where", "n")


_X = analysis.SQL["idx_4"]


@query(f"""WITH x AS ({_X}), a AS (SELECT DISTINCT id, 'eq-full' AS sub_category, path AS xpath, upper(value) AS v FROM x UNION SELECT DISTINCT id, 'eq-double-slash', '//' || tag, upper(value) FROM x)
 SELECT sub_category, 'xml_value(xml, ''' || xpath || ''', ' || CASE WHEN v ~ '^-?[0-9]+$' THEN v ELSE '''' || v || '''' END || ')' AS "where", count(*) AS n FROM a GROUP BY sub_category, xpath, v HAVING count(*) BETWEEN 5 AND 400""")
def wl_xml(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf and path query over the customers' documents with 5 to 400 rows."""
    index = textindex.xml_paths(analysis._xml(spark, d), "id", "xml")
    return C.xml_candidates(index, "xml", 5, 400).select("sub_category", "where", "n")


@query(f"""WITH x AS ({_X}), u AS (SELECT id, path, value, unnest(['/xml', path, regexp_replace(path, '/[^/]*$', '')]) AS node FROM x)
 SELECT node AS path, nullif(regexp_replace(node, '/[^/]*$', ''), '') AS parent, CAST(length(node) - length(replace(node, '/', '')) AS INTEGER) AS depth, count(DISTINCT id) AS n_rows, count(DISTINCT value) FILTER (WHERE node = path) AS n_values FROM u GROUP BY 1""")
def wl_xml_tree(spark: SparkSession, d: str) -> DataFrame:
    """The path summary that the XML queries are drawn from."""
    return C.path_summary(textindex.xml_paths(analysis._xml(spark, d), "id", "xml"))


@query(f"""WITH x AS ({analysis.SQL["idx_3"]}), h AS (SELECT word1, word2, distance, count(*) AS c FROM x GROUP BY 1, 2, 3), s AS (SELECT *, CAST(sum(c) OVER (PARTITION BY word1, word2 ORDER BY distance) AS BIGINT) AS n FROM h)
 SELECT word1, word2, distance, n, 'WORD_PROXIMITY(text, ''' || word1 || ''', ''' || word2 || ''') <= ' || distance || ' ORDER BY WORD_PROXIMITY(text, ''' || word1 || ''', ''' || word2 || ''')' AS "where" FROM s WHERE n >= 3 AND n - c < 3 AND n <= 40""")
def wl_alarm(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of three alarm words the distance within which 3 to 40 documents have both."""
    index = textindex.alarms(table(spark, d, "documents"), "doc_id", ["text"], ["the", "and", "with"])
    return C.alarm_candidates(index, 3, 40).select("word1", "word2", "distance", "n", "where")


# -- ranges over numbers of 0 to 40 bits, made from the orders' keys ----------------------------------------------

_TRIES, _WANTED, _EXPONENTS = 4, 20, list(range(0, 33, 2))
_HEX = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), {}, {}) AS BIGINT)"
_FOO = f"""foo AS (SELECT b AS bits, CASE WHEN b = 0 THEN 0 ELSE (1::BIGINT << (b - 1)) + r % (1::BIGINT << (b - 1)) END AS v FROM (SELECT CAST({_HEX.format(1, 8)} % 41 AS INTEGER) AS b, {_HEX.format(9, 12)} AS r FROM orders)),
 c AS (SELECT bits, count(*) / CASE WHEN bits = 0 THEN 1.0 ELSE pow(2.0, bits - 1) END AS density FROM foo GROUP BY bits),
 a AS (SELECT CAST(e AS INTEGER) AS exponent, CAST(t AS INTEGER) AS try FROM (SELECT unnest({_EXPONENTS}) AS e), (SELECT unnest(range({_TRIES})) AS t)),
 p AS (SELECT exponent, try, bits, CAST('0x' || substr(md5('7|' || exponent || '|' || try || '|' || bits), 1, 8) AS BIGINT) AS h FROM a JOIN c ON bits >= exponent + 2 AND density * pow(2.0, exponent) / {_WANTED} BETWEEN 0.5 AND 1.5),
 w AS (SELECT exponent, try, arg_min(bits, h * 100 + bits) AS bits FROM p GROUP BY 1, 2),
 l AS (SELECT *, (1::BIGINT << (bits - 1)) + CAST((CAST('0x' || substr(md5('7|place|' || exponent || '|' || try), 1, 8) AS HUGEINT) * ((1::BIGINT << (bits - 1)) - (1::BIGINT << exponent) + 1)) // 4294967296 AS BIGINT) AS low FROM w),
 r AS (SELECT exponent, try, bits, low, low + (1::BIGINT << exponent) - 1 AS high, (SELECT count(*) FROM foo WHERE v BETWEEN low AND low + (1::BIGINT << exponent) - 1) AS n FROM l)"""


def _foo(spark: SparkSession, d: str) -> DataFrame:
    """A number for each order, its length in bits even over 0 to 40, by rule of the key."""
    digest = F.md5(F.col("o_orderkey").cast("string"))
    part = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("long")
    top = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") - 1).cast("int"))
    o = table(spark, d, "orders").select((part(1, 8) % 41).cast("int").alias("b"), part(9, 12).alias("r"))
    return o.select(F.when(F.col("b") == 0, F.lit(0)).otherwise(top() + F.col("r") % top()).alias("v"))


@query(f"WITH {_FOO} SELECT exponent, try, bits, low, high, n FROM r")
def wl_foo(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of 2^0 to 2^32 numbers that about 20 rows should be in, and how many are."""
    found = C.log_ranges(_foo(spark, d), "v", _EXPONENTS, _WANTED, _TRIES, 7)
    return found.select("exponent", "try", "bits", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), "n")


@query(f"WITH {_FOO} SELECT exponent, min(try) AS try, arg_min(n, try) AS n FROM r WHERE n BETWEEN 5 AND 40 GROUP BY exponent")
def wl_reffoo(spark: SparkSession, d: str) -> DataFrame:
    """One range query an exponent, the first whose count is in the band."""
    found = C.log_ranges(_foo(spark, d), "v", _EXPONENTS, _WANTED, _TRIES, 7)
    return C.one_an_exponent(found, 5, 40).select("exponent", "try", "n")


# -- stand-ins on data that have the feature ------------------------------------------------------------------


@query(f"""WITH x AS (SELECT word1 || '+' || word2 AS q, distance FROM ({analysis.SQL["idx_3"]})), n AS (SELECT q, count(*) AS n FROM x GROUP BY 1)
 SELECT q, distance, count(*) AS tier FROM x JOIN n USING (q) WHERE n BETWEEN 3 AND 1000000 GROUP BY 1, 2""")
def wl_refprox(spark: SparkSession, d: str) -> DataFrame:
    """Tier sizes by distance of the proximity queries whose size is in the band."""
    from sextant.operators.aggregates import by_distance

    index = textindex.alarms(table(spark, d, "documents"), "doc_id", ["text"], ["the", "and", "with"])
    m = index.select(F.concat_ws("+", "word1", "word2").alias("qid"), "distance")
    good = W.counted(m).where("n between 3 and 1000000").select("qid")
    return by_distance(m.join(good, "qid", "left_semi")).select(F.col("qid").alias("q"), "distance", F.col("n").alias("tier"))

