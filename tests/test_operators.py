"""Rows-only operators, sources and streams on small inputs, against rules worked out by hand."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions import predicates as P
from sextant.functions import scalars as S
from sextant.operators import aggregates, distributions, logs, perf, relational, synth, textindex, windows, workload
from sextant.sources import files
from sextant.streaming import pubsub, series


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- predicates ------------------------------------------------------------------------------------


def test_predicate_forms(spark):
    p = P.Predicate("or", terms=(P.Predicate("eq", "a", "x"), P.Predicate("not", terms=(P.Predicate("range", "n", low=2, high=5),)), P.Predicate("mofn", m=2, terms=(P.Predicate("ge", "n", 1), P.Predicate("has", "a", "q"), P.Predicate("le", "n", 9)))))
    assert p.text() == "(upper(a) = 'X' OR NOT ((n >= 2 AND n <= 5)) OR M_OF_N(2, 3, n >= 1, upper(a) LIKE '%Q%', n <= 9))"
    assert P.shape(p) == {"or_fan_in": 3, "and_fan_in": 0, "depth": 2, "m": 2, "n": 3}
    rows = frame(spark, [("X", 3), ("y", 3), ("y", 7), ("q", None), (None, 3)], "a string, n int")
    assert [r.n for r in rows.where(p.column()).collect()] == [3, 3, 7, 3]
    assert p.row(4)[0] == 4 and len(p.row(4)) == len(P.ROW.split(","))


def test_missing_values_and_bounds(spark):
    rows = frame(spark, [("ab", 1), (None, 2), ("", 3)], "s string, k int")
    score = P.m_of_n(1, P.eq("s", "AB"), F.col("k") > 1)
    assert [r[0] for r in rows.select(score).collect()] == [1, 1, 1]
    assert rows.where(~P.eq("s", "ab")).count() == 1  # unknown stays unknown
    with pytest.raises(ValueError):
        P.between("k", 5, 2)
    with pytest.raises(ValueError):
        P.wild_last("s", "a", 0)


@pytest.mark.parametrize(
    ("text", "column", "want"),
    [
        ("xabc", lambda: P.wild_first("s", "abc"), True), ("abc", lambda: P.wild_first("s", "abc"), False), ("abcx", lambda: P.wild_last("s", "abc"), True),
        ("a.b", lambda: P.wild("s", ["a", "b"]), True), ("a.bc", lambda: P.wild("s", ["a", "b"]), False), ("a.bc", lambda: P.wild("s", ["a", "b"], more_after=True), True),
        ("ca.b", lambda: P.wild("s", ["a", "b"], more_before=True), True), ("axxa.b", lambda: P.wild("s", ["a", "b"], more_before=True, more_after=True), False),
        ("axxa.b", lambda: P.wild("s", ["a", "b"], more_before=True, more_after=True, backtrack=True), True), ("a\n.", lambda: P.wild("s", ["a", "."]), True),
        ("one two, three", lambda: P.contains_word("s", "TWO"), True), ("one twofold", lambda: P.contains_word("s", "two"), False), ("Two", lambda: P.contains_word("s", "two", True), False),
    ],
)
def test_wildcards_and_words(spark, text, column, want):
    assert frame(spark, [(text,)], "s string").select(column()).first()[0] is want


# -- scalars ----------------------------------------------------------------------------------------


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        S.normal_bool(F.lit("no")), S.normal_bool(F.lit("anything")), S.normal_bool(F.lit("None")), S.from_pipes(F.lit("a||b|")), S.birth_date(F.lit(20), F.lit(1)),
        S.last_update(F.lit(dt.date(1980, 1, 1)), F.lit(0.0)), S.epoch(F.lit("20120829"), F.lit("00:00:01")), S.epoch_text(F.lit(1.5)), S.shown(F.lit(None)), S.label(F.lit(2), {1: "one", 2: "two"}),
    ).first()
    assert tuple(got) == (False, True, None, ["a", "b"], dt.date(1992, 12, 31), 315532800, 1346198401, "1970-01-01 00:00:01.500000", "N/A", "TWO")
    widths = frame(spark, [("BIGINT UNSIGNED", None), ("CHAR(9)", None), ("TINYINT", None), ("TEXT", "10000")], "type string, length string")
    assert widths.agg(S.row_width(widths)).first()[0] == 8 + 9 + 1 + 10000


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "happy": "happi", "adjustment": "adjust", "controlling": "control", "agreed": "agre", "filing": "file", "sky": "sky"}
    assert {w: textindex.suffix_stem(w) for w in words} == words


def test_xml_of_any_text(spark):
    rows = frame(spark, [(1, "<a><b>x</b><c><d>y</d></c></a>"), (2, "no xml"), (3, None)], "id long, x string")
    assert {tuple(r)[2:] for r in textindex.xml_paths(rows, "id", "x").collect()} == {("/a/b", "/b", "b", "x"), ("/a/c/d", "/c/d", "d", "y")}


# -- relational, aggregates, windows ------------------------------------------------------------------


def test_changes_keep_the_index_right(spark):
    rows = frame(spark, [(1, "a b"), (2, "c"), (3, "d")], "id long, t string")
    changes = frame(spark, [(1, "z", 1, "update"), (2, None, 2, "delete"), (4, "n", 3, "insert"), (4, "m", 4, "update")], "id long, t string, seq int, op string")
    after = relational.apply_changes(rows, changes)
    assert sorted(map(tuple, after.collect())) == [(1, "z"), (3, "d"), (4, "m")]
    index = textindex.keywords(rows, "id", ["t"])
    fresh = relational.apply_to_index(index, textindex.keywords(after, "id", ["t"]), changes)
    assert Counter(map(tuple, fresh.collect())) == Counter(map(tuple, textindex.keywords(after, "id", ["t"]).collect()))


def test_percentiles_and_quantiles(spark):
    random.seed(1)
    values = [random.randrange(50) for _ in range(137)]
    rows = frame(spark, [(v,) for v in values], "v int").withColumn("g", F.lit(1))
    got = {r.p: r.value for r in aggregates.percentiles(rows, "v", ["g"]).collect()}
    assert got == {p: sorted(values)[(p * 137 + 99) // 100 - 1] for p in range(1, 101)}
    q = aggregates.approximate(rows, "v", ["g"], [0, 0.5, 1]).first()
    assert (q.q0, q.q2) == (min(values), max(values)) and abs(q.q1 - sorted(values)[68]) <= 1


def test_cumulative_over_many_parts(spark):
    rows = frame(spark, [(i, i % 7) for i in range(500)], "k int, w int")
    got = {r.k: (r.c, r.total) for r in aggregates.cumulative(rows, ["k"], "w", "c", parts=9).collect()}
    assert all(got[k] == (sum(i % 7 for i in range(k + 1)), sum(i % 7 for i in range(500))) for k in range(500))


def test_running_sums_keep_the_callers_columns(spark):
    rows = frame(spark, [(i, 10 * i, i, i) for i in range(1, 8)], "k int, total int, _part int, n int")
    star = {r.k: (r.total, r._part, r.star) for r in windows.every_nth(rows, "k", "n", 7, 3).collect()}
    assert star == {i: (10 * i, i, i in (3, 6)) for i in range(1, 8)}
    assert {(r.k, r.total, r.up_to, r.n_from) for r in aggregates.running(rows, "k").collect()} == {(i, 10 * i, i * (i + 1) // 2, 28 - i * (i - 1) // 2) for i in range(1, 8)}


def test_gap_at_the_bound_splits(spark):
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 5, 15, 24)]
    rows = frame(spark, [(1, t) for t in at], "u int, ts timestamp")
    assert sorted(r.n for r in windows.gap_sessions(rows, ["u"], "ts", 10, {}).collect()) == [2, 2]
    assert sorted(r.n for r in series.sessions(rows, "ts", 10, ["u"], {"n": F.count("*")}).collect()) == [2, 2]


def test_regressions(spark):
    rows = frame(spark, [(float(a), float(b), 2 * a - 3.0 * b + 4) for a in range(5) for b in range(4)], "a double, b double, y double")
    coefficients, r2 = perf.plane(rows, [F.col("a"), F.col("b")], F.col("y"))
    assert [round(c, 9) for c in coefficients] == [2, -3, 4] and r2 == 1
    assert perf.plane(rows.where("a = 1 and b = 1"), [F.col("a")], F.col("y")) is None and perf.plane(rows.withColumn("y", F.lit(1.0)), [F.col("a")], F.col("y")) is None


def test_packing_is_greedy(spark):
    rows = frame(spark, [(1, "c", 0, 4.0), (2, "c", 0, 5.0), (3, "c", 0, 3.0), (4, "c", 0, 20.0), (5, "c", 1, 1.0)], "qid long, cat string, band int, seconds double")
    assert {r.qid: r.batch for r in workload.pack(rows, ["cat"], 10).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0}


def test_reorder_by_hand(spark):
    hits = frame(spark, [(1, i) for i in range(3)] + [(2, i) for i in range(2, 9)] + [(3, i) for i in range(8)], "qid long, id long")
    combos = frame(spark, [(7, 1), (7, 2), (7, 3)], "cid long, qid long")
    assert [r.qid for r in workload.reorder(combos, hits).orderBy("pos").collect()] == [1, 2, 3]


def test_schema_rules(spark):
    rows = frame(spark, [(1, "EQ", "a", 1, 5, 1, 2), (2, "XX", "a", 5, 1, 3, 2), (3, "EQ", "zz", -1, 500, 1, 9)], "row int, category string, field string, lower int, upper int, m int, n int")
    faults = Counter(r.row for r in workload.check_schema(rows, 100, ["EQ"], ["a"]).collect())
    assert faults == {2: 3, 3: 4}


# -- synthetic data -------------------------------------------------------------------------------------


def test_draws_follow_weights_and_repeat(spark):
    dist = frame(spark, [("a", 1), ("b", 3), ("c", 6)], "v string, weight long")
    rows = spark.range(4000)
    got = Counter(r.x for r in synth.draw(rows, dist, "v", "id", 3, "x").collect())
    assert sum(got.values()) == 4000 and all(abs(got[v] / 4000 - w / 10) < 0.03 for v, w in (("a", 1), ("b", 3), ("c", 6)))
    cond = frame(spark, [(1, "a", 1), (2, "b", 1), (2, "c", 1)], "p int, v string, weight long")
    drawn = synth.draw_given(frame(spark, [(i, i % 3 + 1) for i in range(90)], "id long, p int"), cond, ["p"], "v", "id", 3, "x").collect()
    assert len(drawn) == 90 and all(r.x == "a" for r in drawn if r.p == 1) and all(r.x in "bc" for r in drawn if r.p == 2)


def test_permutation_and_fields(spark):
    n = spark.range(1 << 10)
    assert n.select(synth.unique(F.col("id"), 10, 5)).distinct().count() == 1 << 10
    rows = synth.people(spark.range(300).withColumnRenamed("id", "k"), "k", 1).collect()
    assert len({r.id for r in rows}) == 300 and all(len(r.ssn) == 9 and r.ssn[:3] not in ("000", "666") for r in rows)
    prints = synth.fingerprint(spark.range(3), "id", 1, 10, 20).collect()
    assert all(10 <= len(r.fingerprint) <= 20 for r in prints)
    model = distributions.next_words(frame(spark, [(1, ["x", "y", "z"])], "id int, w array<string>"), "id", F.col("w"))
    assert [r.text for r in synth.texts(spark.range(1), model, "id", 5, 1, 100).collect()] == ["x y"]
    marked = spark.range(400).select(synth.with_alarms(F.lit("aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp"), F.col("id"), ["FIRE", "WATER"], 2).alias("t")).collect()
    assert 0.7 < sum("FIRE" not in r.t and "WATER" not in r.t for r in marked) / 400 < 0.9


def test_texts_draw_from_the_whole_model(spark):
    """More transitions than the 60,000 that were kept once; the last of the alphabet come too."""
    rare = spark.range(70_000).select(F.lit("").alias("first"), F.lit("").alias("second"), F.format_string("w%05d", "id").alias("following"), F.lit(1).cast("long").alias("n"))
    got = [int(r.text[1:6]) for r in synth.texts(spark.range(2000), rare, "id", 6 + 1, 1).collect()]
    assert len(got) == 2000 and 0.1 < sum(w >= 60_000 for w in got) / 2000 < 0.19
    pairs = frame(spark, [("", "", "a", 3), ("", "", "b", 1), ("", "a", "x", 40), ("", "a", "y", 120), ("", "b", "z", 1)], "first string, second string, following string, n long")
    said = Counter(r.text for r in synth.texts(spark.range(2000), pairs, "id", 4, 1).collect())
    assert set(said) == {"a x", "a y", "b z"} and all(abs(said[t] / 2000 - p) < 0.04 for t, p in (("a x", 0.1875), ("a y", 0.5625), ("b z", 0.25)))


def test_query_of_texts_has_alarms(spark):
    from harness import DATA

    from sextant import registry

    made = [r.text for r in registry.queries()["dg_text"](spark, DATA).collect()]
    count = Counter(sum(w in ("FIRE", "SMOKE", "WATER") for w in t.split()) for t in made)
    assert set(count) == {0, 1, 2} and 0.65 < count[0] / len(made) < 0.95


# -- sources ------------------------------------------------------------------------------------------------


def test_record_files_round_trip(spark, tmp_path):
    rows = frame(spark, [(1, "a", b"\x01\xff"), (2, "two\nlines", b""), (3, "RAW", None), (4, None, b"z")], "id long, t string, b binary")
    files.write_records(rows, str(tmp_path / "r"), 2)
    back = files.read_records(spark, str(tmp_path / "r"), rows.schema)
    want = {(1, "a", b"\x01\xff"), (2, "two\nlines", b""), (3, "RAW", b""), (4, "", b"z")}
    assert {(r.id, r.t, bytes(r.b)) for r in back.collect()} == want
    for text in ("INSERT\n1\nENDINSERT\n", "UPDATE\n", "INSERT\n1\nx\ny\nz\n"):
        with pytest.raises(ValueError):
            list(files.parse_records(text, ["a", "b"]))
    spark.dataSource.register(files.LineRecords)
    one = tmp_path / "one"
    one.write_text(files.format_record(["5", "x\ny"]))
    assert [tuple(r) for r in spark.read.format("linerecords").option("fields", "id string, t string").option("paths", str(one)).load().collect()] == [("5", "x\ny")]


def _split_reads(spark, tmp_path, texts, sizes, schema):
    """Rows that read_records finds for each size of splits."""
    folder = tmp_path / "split"
    folder.mkdir(exist_ok=True)
    for i, t in enumerate(texts):
        (folder / f"f{i}").write_text(t, newline="")
    key, out = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    try:
        for size in sizes:
            spark.conf.set(key, str(size))
            out.append(sorted(tuple(r) for r in files.read_records(spark, str(folder), schema).collect()))
    finally:
        spark.conf.set(key, before)
    return out


def test_record_files_are_equal_in_splits_of_any_size(spark, tmp_path):
    """Texts that hold records of their own, pieces of records, long lines, carriage returns and other writings."""
    rng = random.Random(5)
    inner = "".join(files.format_record([str(k), "z"]) for k in range(6))
    texts, want = [], []
    for f in range(2):
        rows = []
        for i in range(16):
            value = rng.choice(["plain", "", "two\nlines", "RAW", inner, inner[rng.randrange(40) : -rng.randrange(1, 40)], "\nINSERT\n1\n", "INSERT\nENDRAW\nENDINSERT", "\r\nx\r", "é日本\n" * 9, "w" * 300, "\n" * 7])
            rows.append((f * 100 + i, value))
        want += rows
        texts.append("".join(files.format_record([str(k), v]) for k, v in rows))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    for got in _split_reads(spark, tmp_path, texts, [90, 700, 1 << 20], schema):
        assert got == sorted(want)


def test_splits_within_records_of_a_text(spark, tmp_path):
    """Splits that lie in a text of records alone take these for the file's, and give them up again."""
    inner = "".join(files.format_record([str(k), "z"]) for k in range(150))
    rows = [("1", "a"), ("2", inner), ("3", "b")]
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.StringType())])
    for got in _split_reads(spark, tmp_path, ["".join(map(files.format_record, rows)), files.format_record(["9", "c"])], [300, 1500], schema):
        assert got == sorted([*rows, ("9", "c")])


def test_wrong_record_files_are_told(spark, tmp_path):
    good = "".join(files.format_record([str(k), "x"]) for k in range(50))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.StringType())])
    for i, bad in enumerate(("INSERT\n1\nENDINSERT\n", "UPDATE\n", "INSERT\n1\nRAW\n900\nx\n", "INSERT\n1\n")):
        folder = tmp_path / str(i)
        folder.mkdir()
        for size in (300, 1 << 20):
            with pytest.raises(ValueError, match="record"):
                _split_reads(spark, folder, [good + bad], [size], schema)


def test_record_sink_commits_whole_jobs(spark, tmp_path):
    spark.dataSource.register(files.LineRecords)
    path = tmp_path / "sink"
    rows = spark.range(25).repartition(3).select(F.col("id").cast("string"), F.concat(F.lit("a\n"), "id").alias("t"))
    write = lambda df, mode: df.write.format("linerecords").option("path", str(path)).option("rowsPerFile", "4").mode(mode).save()
    read = lambda: sorted(tuple(r) for r in spark.read.format("linerecords").option("fields", "id string, t string").option("paths", str(path)).load().collect())
    write(rows, "append")
    want = sorted((str(i), f"a\n{i}") for i in range(25))
    assert read() == want and max(p.read_text().count("ENDINSERT") for p in path.iterdir()) == 4
    broken = rows.select("id", F.when(F.col("id") == "20", F.raise_error(F.lit("lost"))).otherwise(F.col("t")).alias("t"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            write(broken, mode)
        assert read() == want and not [p for p in path.iterdir() if p.is_dir()]
    write(rows, "append")
    assert read() == sorted(want * 2)
    write(rows.where("id = '3'"), "overwrite")
    assert read() == [("3", "a\n3")]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = ["", "a", "b\r", *(f"line {i}" for i in range(500)), "é", ""]
    (tmp_path / "l").write_text("\n".join([*lines, ""]), newline="")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in ("50", "1000", "1m"):
            spark.conf.set(key, size)
            got = [(r.line, r.value) for r in files.numbered_lines(spark, str(tmp_path / "l")).orderBy("line").collect()]
            assert got == [(i, v.removesuffix("\r")) for i, v in enumerate(lines, 1)]
    finally:
        spark.conf.set(key, before)


def test_schema_file(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("name,type,table,length,index\nid,BIGINT UNSIGNED,base:notes,,\nname,CHAR(9),base,,\nnotes1,TEXT,notes,10000,\nhash,CHAR(32),row_hashes,,\n")
    schema, tables = files.schema_csv(spark, str(path))
    assert schema.fieldNames() == ["id", "name", "notes1"] and schema["id"].dataType == T.DecimalType(20, 0)
    assert tables == {"base": ["id", "name"], "notes": ["id", "notes1"]}
    split = files.split_tables(frame(spark, [(1, "n", "t")], "id long, name string, notes1 string"), tables, hashed=True)
    assert set(split) == {"base", "notes", "row_hashes"} and split["notes"].columns == ["id", "notes1"]


def test_line_files(spark, tmp_path):
    (tmp_path / "c").write_text("H00000000AB\nP0000000000000515\nP0000000000000020\nH00000000CD\nP0000000000000730\n")
    lines = files.numbered_lines(spark, str(tmp_path / "c"))
    assert [r.line for r in lines.orderBy("line").collect()] == [1, 2, 3, 4, 5]
    got = files.census(lines, {"state": (10, 11)}, {"age": (16, 17)}).orderBy("line").collect()
    assert [(r.state, r.weight) for r in got] == [("AB", 51), ("AB", 2), ("CD", 73)]
    (tmp_path / "n").write_text("SMITH          1.006  1.006      1\nJONES          0.621\nnothing\n")
    assert {tuple(r) for r in files.name_frequencies(files.numbered_lines(spark, str(tmp_path / "n"))).collect()} == {("SMITH", 1007), ("JONES", 622)}
    (tmp_path / "cpu").write_text("# comment\n#Date Time [CPU:0]User% [CPU:1]User% Other\n20120829 00:00:01 5 6.5 7\n")
    cpu = files.collectl(files.numbered_lines(spark, str(tmp_path / "cpu")), r"\[CPU:(\d+)\](.*)").collect()
    assert {(r.unit, r.metric, r.value) for r in cpu} == {("0", "User%", 5.0), ("1", "User%", 6.5)}
    (tmp_path / "t").write_text("12:00:01.5 IP (tos 0x0, length 60)\n    a.1 > b.2: Flags\n12:00:02.5 IP (length 52)\n    b.2 > a.1: Flags\n")
    assert [(r.length, r.source, r.target) for r in files.tcpdump(files.numbered_lines(spark, str(tmp_path / "t"))).orderBy("time").collect()] == [(60, "a.1", "b.2"), (52, "b.2", "a.1")]
    (tmp_path / "i").write_text("host = h1\nHost = h2\nruns: 3\n")
    assert tuple(files.test_runs(files.numbered_lines(spark, str(tmp_path / "i")), ["host", "runs"]).first())[1:] == ("h1?h2", "3")


def test_table_sink(spark, tmp_path):
    rows = frame(spark, [("1", "None", "yes", "1|2|"), ("x", "2.5", "0", "")], "a string, b string, c string, d string")
    typed = files.normalised(rows, {"a": "integer", "b": "real", "c": "bool", "d": "list"})
    assert [tuple(r) for r in typed.collect()] == [(1, None, True, ["1", "2"]), (None, 2.5, False, [])]
    files.write_csv(typed, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).where("d = '1|2'").count() == 1


# -- logs ------------------------------------------------------------------------------------------------------


def test_client_log(spark, tmp_path):
    (tmp_path / "log").write_text(
        "[9.0] 2013-01-02 03:04:05 LAB-x-TC7_y\n[10.0] ID 0-1 sent\n[10.0] ID 0-1 QID 7: [[SELECT a, b FROM main WHERE x = ']]']]\n[10.5] ID 0-1 event 99 occurred\n[12.0] ID 0-1 results:\n30 abc\n4 0f\n"
        "[12.5] ID 0-1 event 5 with value [[77]] occurred\n17\nrow text\n[9.5] ID 0-1 event 3 occurred\n"
        "[13.0] ID 0-2 sent\n[13.0] ID 0-2 QID 8: [[SELECT id FROM main WHERE y]]\n[14.0] ID 0-2 results:\nFAILED with reason\nbroken 5\n\n[14.5] ID 0-2 event 6 occurred\nmore\nENDFAILED\n12 ab\nFAILED\nENDFAILED\n"
        "[15.0] ID 0-3 sent\nstray\n[16.0] something else\n[16.5] ID 0-4 QID 9: [[SELECT id FROM main WHERE z]]\n[17.0] ID 0-4 results:\n1\n"
        "[18.0] END_OF_LOG\n[19.0] ID 0-5 sent\n[19.0] ID 0-5 QID 7: [[SELECT * FROM main WHERE x]]\n[20.0] ID 0-5 results:\n"
    )
    lines = files.numbered_lines(spark, str(tmp_path / "log"))
    for parts in (None, 1, 5, 40):
        rows = {r.cmd: r for r in logs.client(lines, parts).collect()}
        assert set(rows) == {"0-1", "0-2"}
        r = rows["0-1"]
        assert (r.performer, r.test_case, r.qid, r.cols, r.query, r.latency) == ("LAB", "TC7", 7, "a, b", "x = ']]'", 2.0)
        assert ([int(i) for i in r.ids], r.hashes, r.bad_ids) == ([4, 17, 30], ["0f", "abc"], ["row text"])
        assert (r.events, r.event_times, r.event_values, r.status) == (["99", "5"], [10.5, 12.5], [None, "77"], [])
        r = rows["0-2"]
        assert (r.status, r.failures, [int(i) for i in r.ids], r.events) == (["FAILED", "broken 5", "more", "FAILED"], ["FAILED with reason", "broken 5", "more", "FAILED"], [12], ["6"])


def test_context_is_carried_over_any_ranges(spark):
    made = [(f"f{i % 3}", i, f"v{i}" if i % 7 == 0 else None, i if i % 50 == 3 else None) for i in range(300)]
    df = frame(spark, made, "file string, line long, a string, b int")
    for parts in (1, 4, 60):
        got = {(r.file, r.line): (r.x, r.y) for r in logs.carry(df, {"x": F.col("a"), "y": F.col("b")}, parts).collect()}
        for f, i, *_ in made:
            before = [m for m in made if m[0] == f and m[1] <= i]
            assert got[f, i] == (next((m[2] for m in reversed(before) if m[2]), None), next((m[3] for m in reversed(before) if m[3] is not None), None))


def test_server_and_circuit_logs(spark, tmp_path):
    (tmp_path / "s").write_text("[1.0] ID 1-1 sent\n[1.0] ID 1-1 MID 5: INSERT 44\n[3.5] ID 1-1 results: DONE\n[4.0] ID 1-2 sent\n[4.0] ID 1-2 VERIFY 45\n[5.0] ID 1-2 results: VERIFY FALSE\n")
    rows = {r.cmd: r for r in logs.server(files.numbered_lines(spark, str(tmp_path / "s"))).collect()}
    assert (rows["1-1"].mid, rows["1-1"].category, int(rows["1-1"].record_id), rows["1-1"].latency) == (5, "insert", 44, 2.5)
    assert rows["1-2"].verification == 0 and int(rows["1-2"].record_id) == 45
    (tmp_path / "c").write_text(
        "junk: 1\nTEST: t of it\nPERFORMER: a lab\nTIME: 2013-01-01 00:00:09\nKEYPARAMS: k1\nKEYGEN: 1.5\nKEYGEN: 1.75\nINPUT: i1\nENCRYPT: 3\nDECRYPTED RESULT: [01]\nKEYSIZE: 9\n"
        "TEST: u of it\nINPUT: i1\nRECOVERY\nDECRYPT: 2\nINPUT: i1\n"
    )
    for parts in (None, 7):
        got = [tuple(r)[1:] for r in logs.circuit(files.numbered_lines(spark, str(tmp_path / "c")), parts).orderBy("record").collect()]
        at = ("a lab", "2013-01-01 00:00:09")
        assert got == [
            (5, "t", *at, "KEYPARAMS", "k1", False, {"KEYGEN": "1.75"}), (8, "t", *at, "INPUT", "i1", False, {"ENCRYPT": "3", "DECRYPTED RESULT": "[01]"}),
            (13, "u", *at, "INPUT", "i1", True, {"DECRYPT": "2"}), (16, "u", *at, "INPUT", "i1", False, {}),
        ]


# -- streams -------------------------------------------------------------------------------------------------


def run_stream(spark, rows, tmp_path, build, mode="append"):
    rows.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_matching_stream_is_the_batch(spark, tmp_path):
    pubs = frame(spark, [(1, "red", 5), (2, "blue", 50), (3, "RED", None), (4, None, 7)], "k long, colour string, n int")
    terms = frame(spark, [(1, 0, 0, False, "colour", "=", "red", None, None), (2, 0, 0, False, "n", ">=", "6", 6.0, None), (3, 0, 0, True, "colour", "=", "red", None, None), (4, 0, 0, False, "colour", "=", "blue", None, None), (4, 0, 1, True, "n", ">", "40", 40.0, None)], pubsub.TERMS)
    want = {(1, 1), (3, 1), (2, 2), (4, 2), (2, 3), (4, 3)}
    assert {tuple(r) for r in pubsub.match(pubs, terms, "k", ["colour", "n"]).collect()} == want

    def deliver(batch, _):
        pubsub.match(batch, terms, "k", ["colour", "n"]).write.mode("append").parquet(str(tmp_path / "found"))

    pubs.repartition(4).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(pubs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(deliver).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "found")).collect()} == want


def test_clock_stream(spark, tmp_path):
    rows = frame(spark, [("a", 1, 10.0, None), ("a", 2, 11.0, 111.0), ("a", 3, 13.0, None), ("b", 1, 5.0, 50.0), ("b", 2, 6.0, None)], "source string, line long, local double, sync double")
    got = {(r.source, r.line): r.true_time for r in run_stream(spark, rows, tmp_path, series.clock)}
    assert got == {("a", 1): None, ("a", 2): 111.0, ("a", 3): 113.0, ("b", 1): 50.0, ("b", 2): 51.0}


def test_window_stream(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, h, m) for h, m in ((0, 0), (0, 30), (1, 10), (5, 0))]
    rows = frame(spark, [(1, t, float(i)) for i, t in enumerate(at)], "u int, ts timestamp, v double")
    got = run_stream(spark, rows, tmp_path, lambda s: series.tumbling(s, "ts", "1 hour", ["u"], {"n": F.count("*")}), "complete")
    assert Counter(r.n for r in got) == {2: 1, 1: 2}


def test_running_sums_over_many_ranges(spark):
    """Sums by ranges are those of one window, with a wide table, groups that span ranges, nulls and ties."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sextant.operators.aggregates import cumulative, percentiles

    rows = spark.range(120_000).select(
        F.when(F.col("id") % 1000 != 7, F.pmod(F.xxhash64("id"), F.lit(90_000))).alias("k"), (F.col("id") % 13).alias("w"),
        F.when(F.col("id") % 3 > 0, F.lit("large")).when(F.col("id") % 17 > 0, F.lit("small")).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("more"),
    )
    for by in ((), ("g",)):
        got = cumulative(rows, ["k", "more"], "w", "up", by=by, parts=24)
        series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        want = rows.withColumn("up", F.sum("w").over(series.orderBy("k", "more").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(series))
        columns = ["k", "w", "g", "more", "up", "total"]
        assert got.count() == 120_000 and got.select(columns).exceptAll(want.select(columns)).isEmpty()
    counted = rows.where("k is not null").groupBy("g").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("all"))
    ranks = {r.g: (r.n, r["all"]) for r in counted.collect()}
    found = percentiles(rows, "k", ["g"]).collect()
    assert len(found) == 300 and all(r.value == ranks[r.g][1][(r.p * ranks[r.g][0] + 99) // 100 - 1] for r in found)


def test_quantile_and_session_streams(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, h, m) for h, m in ((0, 0), (0, 30), (1, 10), (5, 0), (5, 20), (9, 0))]
    rows = frame(spark, [(1, t, float(i)) for i, t in enumerate(at)], "u int, ts timestamp, v double")
    got = run_stream(spark, rows, tmp_path, lambda s: series.quantiles(s, "ts", "6 hours", "v", [0.0, 1.0]), "complete")
    assert {(r.n, tuple(r.quantiles)) for r in got} == {(5, (0.0, 4.0)), (1, (5.0, 5.0))}


def test_deliveries_once_on_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = frame(spark, [(1, 1, at(0)), (1, 1, at(1)), (1, 2, at(2)), (2, 1, at(3)), (2, 1, at(9))], "pub long, sub long, at timestamp")
    got = run_stream(spark, rows, tmp_path, lambda s: pubsub.once(s, "at", "1 minute"))
    assert Counter((r.pub, r.sub) for r in got) == {(1, 1): 1, (1, 2): 1, (2, 1): 1}


def test_random_trees(spark):
    import xml.etree.ElementTree as ET

    from harness import DATA

    from sextant import registry

    made = registry.queries()["dg_xml_tree"](spark, DATA).collect()
    tops = Counter()
    for r in made:
        root = ET.fromstring(r.xml)
        assert root.tag == "xml" and [len(root), *{len(a) for a in root}, *{len(b) for a in root for b in a}] == [5, 5, 5]
        assert all(len({leaf.tag for leaf in b}) == 5 for a in root for b in a) and all(b.tag[0] == "b" for a in root for b in a)
        tops.update(a.tag for a in root)
    n, weights = sum(tops.values()), synth.tag_weights()
    assert len(made) == len({r.c_custkey for r in made}) and weights == [1, 5, 10, 10, 50, 100, 100]
    assert all(abs(tops[f"a{i}"] / n - w / sum(weights)) < 0.1 for i, w in enumerate(weights))


def test_random_trees_are_dealt_before_they_are_made(spark):
    """The customers are few bytes, so that one task would make all branches; afterwards no branch is shuffled."""
    import re

    from harness import DATA

    from sextant import registry

    plan = registry.queries()["dg_xml_tree"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 1 and plan.index("Exchange ") > plan.index("Generate explode")
    assert f"{spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in plan


def test_zip_and_street_files(spark, tmp_path):
    (tmp_path / "z.csv").write_text("zip code, state, city\n10001, New York, New York\n10001, New York, Harlem\n02134, Maine, Allston\n")
    (tmp_path / "s.csv").write_text("zip,fullname\n10001,Main St\n10001,Main St\n02134,High St\n")
    by_state, by_zip = files.zip_codes(spark, str(tmp_path / "z.csv"))
    assert {tuple(r) for r in by_state.collect()} == {("New_York", "10001", 2), ("Maine", "02134", 1)}
    assert {tuple(r) for r in by_zip.collect()} == {("10001", "New York", 1), ("10001", "Harlem", 1), ("02134", "Allston", 1)}
    assert {tuple(r) for r in files.streets(spark, str(tmp_path / "s.csv")).collect()} == {("10001", "Main St", 2), ("02134", "High St", 1)}


def test_keys_of_test_runs(spark):
    rows = [("f", 1, "match_rate = ~5"), ("f", 2, "unique_matches: exactly 5 rows"), ("f", 3, "disjunction_ratio=0.50"), ("f", 4, "disjunction_prob=0.5"), ("f", 5, "pub_wait=1"), ("f", 6, "publication_timeout=2"), ("g", 1, "test_script = t")]
    got = {r.file: tuple(r)[1:] for r in files.test_runs(frame(spark, rows, "file string, line long, value string"), ["unique_matches", "disjunction_prob", "pub_wait", "testname"]).collect()}
    assert got == {"f": ("exactly 5 rows", "0.5", "1?2", None), "g": (None, None, None, "t")}


def test_a_split_is_held_once_as_bytes():
    """A split's records come in batches, and a wide character does not widen the rest of its bytes."""
    import tracemalloc

    values = [[str(k), f"x\nä{k}\U0001f600 " + "y" * 50] for k in range(260_000)]
    text = bytearray("".join(map(files.format_record, values)).encode())
    cut = bytes(text[-20:])
    del text[-20:]
    tracemalloc.start()
    start, end = files.synchronise(text, ["a", "b"], False)
    n = most = 0
    for part in files._between(text, ["a", "b"], start, end):
        assert part == values[n : n + len(part)]
        n, most = n + len(part), max(most, len(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(values) - 1 and most < len(values) / 3 and peak < len(text), (n, most, peak, len(text))
    assert list(files.parse_records((text[end:] + cut).decode(), ["a", "b"])) == values[-1:]
