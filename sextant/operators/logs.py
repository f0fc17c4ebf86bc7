"""Harness logs as tables: tagged lines, carried context, grouped commands.

A log is read as (file, line, value), where ``line`` may be a number or a byte
offset, whatever orders the lines of a file. What a line means depends on lines
before it: the command whose results are listed, whether a failure is open, the
test case. That context is carried over ranges of lines: each range is folded on
its own, the ranges' last values run over the ranges, and a line takes what its
range has before it or else what came in. So a log of any size is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.scratch import written

#: Patterns of the log lines.
STAMP = r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:.]+|[0-9.]+)\] ?(.*)$"
COMMAND = r"ID (\d+-\d+)"
TEST_CASE = r"^[0-9-]{10} [0-9:]{8} ([^-]+)-[^-]+-([^_]+)_.+"
QUERY = r"ID \d+-\d+ QID (\d+): \[\[SELECT (.+) FROM main WHERE (.*)\]\]"
EVENT = r"ID \d+-\d+ event (\d+)(?: with value \[\[(\d+)\]\])? occurred"
MODIFICATION, VERIFICATION = r"MID (\d+): (INSERT|DELETE|UPDATE) (\d+)", r"VERIFY (\d+)"
#: Sections of a circuit log and the measures that each has.
SECTIONS = {
    "KEYPARAMS": ("KEYGEN", "KEYTRANSMIT", "KEYSIZE"),
    "CIRCUIT": ("INGESTION", "CIRCUITTRANSMIT"),
    "INPUT": ("ENCRYPT", "INPUTTRANSMIT", "INPUTSIZE", "EVAL", "OUTPUTTRANSMIT", "OUTPUTSIZE", "DECRYPTED RESULT", "DECRYPT"),
}


def stamped(lines: DataFrame, column: str = "value") -> DataFrame:
    """``stamp`` and ``rest`` of lines that begin with a time in brackets; both null on others."""
    found = lambda k: F.when(F.col(column).rlike(STAMP), F.regexp_extract(column, STAMP, k))
    return lines.withColumns({"stamp": found(1), "rest": found(2)})


def carry(lines: DataFrame, values: dict[str, Column], parts: int | None = None, file: str = "file", line: str = "line") -> DataFrame:
    """``lines`` with, for each name, the last non-null value at or before each line of its file.

    Lines are dealt by ranges of (file, line) and written once with the number
    of their range, so a file of any size is spread over tasks; of each range
    the last values go on, one row a range and file.
    """
    keys = [F.col(file), F.col(line)]
    ranged = lines.withColumns(values)
    ranged = ranged.repartitionByRange(parts, *keys) if parts else ranged.repartitionByRange(*keys)
    marked = written(ranged.withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", file).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(file).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = marked.groupBy("_part", file).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(line))).alias(n) for n in values])
    ends = ends.select("_part", F.col(file).alias("_file"), *[F.last(n, True).over(before).alias(f"_{n}") for n in values])
    ends = ends.withColumnRenamed("_part", "_range")
    joined = marked.withColumns({n: F.last(n, True).over(here) for n in values}).join(ends, (F.col("_part") == F.col("_range")) & F.col(file).eqNullSafe(F.col("_file")))
    return joined.withColumns({n: F.coalesce(n, f"_{n}") for n in values}).drop("_part", "_range", "_file", *[f"_{n}" for n in values])


def _named(column: str, pattern: str, k: int = 1) -> Column:
    return F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, k))


def _clean(lines: DataFrame) -> DataFrame:
    """Lines without blanks at the ends, empty ones left out."""
    return stamped(lines.withColumn("value", F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))).where("value <> ''"))


def commands(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """The lines of a client or server log with ``cmd``, ``kind``, ``performer`` and ``test_case``.

    ``kind`` of a stamped line: case, sent, query, modification, verification,
    results, event or other. A line without a time belongs to the results that
    are open: data, failed (``FAILED`` and any text), endfailed, or message, a
    line between those two; without open results it is stray. Stamped lines other
    than events close the results.
    """
    rows = _clean(lines)
    rest = F.col("rest")
    kind = (
        F.when(rest.rlike(TEST_CASE), "case").when(rest.rlike(r"^ID \d+-\d+ sent"), "sent").when(rest.rlike("^" + QUERY), "query").when(rest.rlike(rf"^{COMMAND} {MODIFICATION}"), "modification")
        .when(rest.rlike(rf"^{COMMAND} {VERIFICATION}"), "verification").when(rest.rlike(r"^ID \d+-\d+ results:"), "results").when(rest.rlike("^" + EVENT), "event").when(rest.isNotNull(), "other")
    )
    own = F.when(rest.isNotNull(), F.when(F.col("k").isin("sent", "query", "modification", "verification", "results", "event"), F.regexp_extract("rest", "^" + COMMAND, 1)))
    rows = rows.withColumn("k", kind).withColumn("own", own)
    opened = F.when(F.col("k") == "results", F.col("own")).when(F.col("k").isNotNull() & (F.col("k") != "event"), F.lit(""))
    failing = F.when(F.col("k").isNull() & F.col("value").startswith("FAILED"), True).when((F.col("value") == "ENDFAILED") | (F.col("k").isNotNull() & (F.col("k") != "event")), False)
    case = F.when(F.col("k") == "case", F.struct(F.regexp_extract("rest", TEST_CASE, 1).alias("performer"), F.regexp_extract("rest", TEST_CASE, 2).alias("test_case")))
    # nothing counts after the log's end, which is carried too: a join on the file would bring each file into one task
    ended = F.when(rest.startswith("END_OF_LOG"), True)
    rows = carry(rows, {"opened": opened, "failing": failing, "case": case, "ended": ended}, parts).where("ended is null").drop("ended")
    inside = F.col("opened").isNotNull() & (F.col("opened") != "")
    bare = (
        F.when(~inside, "stray").when(F.col("value") == "ENDFAILED", "endfailed").when(F.col("value").startswith("FAILED"), "failed")
        .when(F.coalesce("failing", F.lit(False)), "message").otherwise("data")
    )
    rows = rows.withColumn("kind", F.coalesce("k", bare)).withColumn("cmd", F.coalesce("own", F.when(inside, F.col("opened"))))
    return rows.withColumns({"performer": F.coalesce("case.performer", F.lit("PERF")), "test_case": F.coalesce("case.test_case", F.lit("000"))}).drop("k", "own", "opened", "failing", "case")


def _listed(kinds: Sequence[str], *fields: Column) -> Column:
    """A command's lines of some kinds in order, as structs."""
    return F.sort_array(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("line", *fields))))


def _each(c: str, field: str) -> Column:
    return F.transform(c, lambda x: x[field])


def _statuses(c: str) -> Column:
    """``FAILED`` for each failure, then its messages."""
    return F.transform(c, lambda x: F.when(x["kind"] == "failed", "FAILED").otherwise(x["value"]))


def client(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a command of a client log that was sent, named a query and has results.

    ``lines``: file, line, value. ids are in order, with their hashes beside them
    where lines have one; ``bad_ids`` are result lines that begin with no number.
    Events count between the command's sending and its last line, with their
    times and values (null without one). ``status`` has FAILED and its messages.
    A command's lines are what a group holds.
    """
    rows = commands(lines, parts)
    when = lambda k, c: F.max(F.when(F.col("kind") == k, c))
    stamp = F.col("stamp").try_cast("double")
    number, hashed = F.regexp_extract("value", r"^(\d+)", 1).try_cast("decimal(20,0)"), F.regexp_extract("value", r"^\d+ ([0-9a-f]+)", 1)
    out = rows.where("cmd is not null").groupBy("file", "cmd").agg(
        when("sent", stamp).alias("send_time"), when("results", stamp).alias("results_time"), F.max(F.when(F.col("kind") == "sent", F.col("performer"))).alias("performer"),
        F.max(F.when(F.col("kind") == "sent", F.col("test_case"))).alias("test_case"), when("query", F.regexp_extract("rest", QUERY, 1)).cast("long").alias("qid"),
        when("query", F.regexp_extract("rest", QUERY, 2)).alias("cols"), when("query", F.regexp_extract("rest", QUERY, 3)).alias("query"),
        _listed(["data"], number.alias("id"), F.nullif(hashed, F.lit("")).alias("hash"), "value").alias("_d"),
        _listed(["event"], stamp.alias("t"), F.regexp_extract("rest", EVENT, 1).alias("e"), F.nullif(F.regexp_extract("rest", EVENT, 2), F.lit("")).alias("v")).alias("_e"),
        _listed(["failed", "message"], "kind", "value").alias("_f"),
    )
    good = F.sort_array(F.transform(F.filter("_d", lambda x: x["id"].isNotNull()), lambda x: F.struct(x["id"].alias("id"), x["hash"].alias("hash"))))
    heard = F.filter("_e", lambda x: x["t"] >= F.col("send_time"))
    out = out.where("send_time is not null and cols is not null and results_time is not null").withColumns({"_r": good, "_h": heard})
    return out.select(
        "file", "cmd", "performer", "test_case", "qid", "cols", "query", "send_time", "results_time", (F.col("results_time") - F.col("send_time")).alias("latency"), _each("_r", "id").alias("ids"),
        F.filter(_each("_r", "hash"), lambda h: h.isNotNull()).alias("hashes"), _each("_h", "t").alias("event_times"), _each("_h", "e").alias("events"), _each("_h", "v").alias("event_values"),
        _statuses("_f").alias("status"), F.transform(F.filter("_d", lambda x: x["id"].isNull()), lambda x: x["value"]).alias("bad_ids"),
        _each("_f", "value").alias("failures"),
    )


def server(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a command of a server log: modification or verification, times, status, failures."""
    rows = commands(lines, parts)
    rest = F.col("rest")
    pick = lambda k, p, at=1: F.max(F.when(F.col("kind") == k, F.regexp_extract(rest, p, at)))
    stamp = F.col("stamp").try_cast("double")
    at = lambda k: F.max(F.when(F.col("kind") == k, stamp))
    out = rows.where("cmd is not null").groupBy("file", "cmd").agg(
        F.max("performer").alias("performer"), F.max("test_case").alias("test_case"), pick("modification", MODIFICATION).cast("long").alias("mid"), F.lower(pick("modification", MODIFICATION, 2)).alias("category"),
        F.coalesce(pick("modification", MODIFICATION, 3), pick("verification", VERIFICATION)).cast("decimal(20,0)").alias("record_id"), at("sent").alias("send_time"), at("results").alias("results_time"),
        F.max(F.when(rest.rlike(r"results: VERIFY FALSE"), 0).when(rest.rlike(r"results: VERIFY TRUE"), 1)).alias("verification"),
        F.max((rest.rlike("results: FAILED") & (F.col("kind") == "results") | (F.col("kind") == "failed")).cast("int")).alias("failed"),
        _listed(["failed", "message", "data"], "kind", "value").alias("_f"),
    )
    failures = F.transform(F.filter("_f", lambda x: x["value"] != "FAILED"), lambda x: x["value"])
    return out.withColumns({"latency": F.col("results_time") - F.col("send_time"), "failures": failures}).drop("_f")


def circuit(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a record of a circuit log: file, ``record`` (its first line), test, performer, time, section, path, recovery, and ``measures``.

    A record is what follows a KEYPARAMS, CIRCUIT or INPUT line up to the next
    one; measures are those of its section, by name, the last of repeated ones.
    Lines of the section before it that come late are left out, as are lines
    before the first record.
    """
    token = r"^([A-Z]+(?: [A-Z]+)*): *(.+)$"
    rows = lines.withColumn("value", F.trim("value")).withColumns({"name": _named("value", token), "v": _named("value", token, 2)})
    head = lambda *names: F.when(F.col("name").isin(*names), F.col("v"))
    record = F.when(F.col("name").isin(*SECTIONS), F.struct(F.col("line").alias("at"), F.col("name").alias("section"), F.col("v").alias("path")))
    test = F.regexp_extract(head("TEST"), r"^(\S+)", 1)
    rows = carry(rows.withColumn("recovery", F.col("value").startswith("RECOVERY")), {"test": test, "performer": head("PERFORMER"), "time": head("TIME"), "record": record}, parts)
    rows = rows.where("record is not null")
    known = F.lit(False)
    for section, names in SECTIONS.items():
        known = known | ((F.col("record.section") == section) & F.col("name").isin(*names))
    named = F.when(F.coalesce(known, F.lit(False)), F.struct("line", "name", "v"))
    out = rows.groupBy("file", F.col("record.at").alias("record")).agg(
        *[F.coalesce(F.min_by(c, "line"), F.max_by(c, "line")).alias(c) for c in ("test", "performer", "time")], F.first("record.section").alias("section"),
        F.first("record.path").alias("path"), F.max("recovery").alias("recovery"), F.sort_array(F.collect_list(named)).alias("_m"),
    )
    last = F.filter("_m", lambda x, i: ~F.exists(F.slice("_m", i + 2, F.size("_m")), lambda y: y["name"] == x["name"]))
    return out.select("file", "record", "test", "performer", "time", "section", "path", "recovery", F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["v"]))).alias("measures"))


def event_lists(rows: DataFrame, by: Sequence[str], time: str, ident: str, val: str) -> DataFrame:
    """Times, ids and values of each group's events, aligned and in order of time."""
    s = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(ident).alias("i"), F.col(val).alias("v"))))
    out = rows.groupBy(*by).agg(s.alias("_s"))
    part = lambda k: F.transform("_s", lambda x: x[k])
    return out.select(*by, part("t").alias("times"), part("i").alias("ids"), part("v").alias("vals"))


def aligned(rows: DataFrame, query: str, ident: str, hashed: str) -> DataFrame:
    """Ids in order with their hashes beside them; empty ones are left out."""
    s = F.sort_array(F.collect_list(F.struct(F.col(ident).alias("i"), F.col(hashed).alias("h"))))
    kept = rows.where(F.col(ident).isNotNull() & (F.coalesce(hashed, F.lit("")) != ""))
    return kept.groupBy(query).agg(s.alias("_s")).select(query, F.transform("_s", lambda x: x["i"]).alias("ids"), F.transform("_s", lambda x: x["h"]).alias("hashes"))


def pre_post(runs: DataFrame, query: str = "qid", run: str = "run") -> DataFrame:
    """The earlier and the later of exactly two runs of a query; queries with other numbers are not complete."""
    two = F.count("*") == 2
    return runs.groupBy(query).agg(F.when(two, F.min(run)).alias("pre"), F.when(two, F.max(run)).alias("post"), two.alias("complete"))


def lacking(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that lack a required column's value."""
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    return rows.where(bad)


def inconsistent(rows: DataFrame, query: str = "query", run: str = "run", row: str = "row") -> DataFrame:
    """Queries whose runs gave different sets of rows: a run's set is told by an order-free sum of hashes."""
    sets = rows.groupBy(query, run).agg(F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    return sets.groupBy(query).agg(F.count_distinct("h", "n").alias("n_results")).where("n_results > 1")


def upsert(known: DataFrame, new: DataFrame, query: str, result: str) -> DataFrame:
    """What to do with each new result: insert it, append its timings, or delete the query as its results differ."""
    old = known.select(query, F.col(result).alias("_old"), F.lit(True).alias("_is"))
    action = F.when(F.col("_is").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col(result)), "append").otherwise("delete")
    return new.join(old, query, "left").withColumn("action", action).drop("_old", "_is")
