"""Registered queries: tables written in the assessment's file formats and read back, in splits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.scratch import shared_dir
from sextant.sources import files

from ._tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sextant-files-{uuid.uuid4().hex}"


@query("SELECT doc_id, source, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents")
def src_1(spark: SparkSession, d: str) -> DataFrame:
    """Documents as record files and back: whole texts of many lines, each a block of its own length."""
    path = _folder(spark)
    files.write_records(table(spark, d, "documents").select("doc_id", "source", "text"), path, 100_000)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])
    return files.read_records(spark, path, schema).select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, hex(o_orderpriority) AS priority FROM (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders)""")
def src_2(spark: SparkSession, d: str) -> DataFrame:
    """Orders as record files and back: numbers, dates, and priorities as binary."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("date").alias("o_orderdate"), F.col("o_orderpriority").cast("binary").alias("o_orderpriority"))
    path = _folder(spark)
    files.write_records(orders, path, 100_000)
    back = files.read_records(spark, path, orders.schema)
    return back.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.hex("o_orderpriority").alias("priority"))


#: Event ids of a file.
FILE = 65_536


@query(f"SELECT event_id // {FILE} AS file, row_number() OVER (PARTITION BY event_id // {FILE} ORDER BY event_id) AS line, event_id FROM events")
def src_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as text files, one for each range of ids, and each event's line number in its file."""
    path = _folder(spark)
    events = table(spark, d, "events").select(F.expr(f"event_id div {FILE}").alias("u"), F.col("event_id").cast("string").alias("value"))
    events.repartition("u").sortWithinPartitions("u", F.col("value").cast("long")).write.partitionBy("u").text(path)
    lines = files.numbered_lines(spark, path)
    return lines.select(F.regexp_extract("file", "u=([0-9]+)", 1).cast("long").alias("file"), F.col("line").cast("long").alias("line"), F.col("value").cast("long").alias("event_id"))
