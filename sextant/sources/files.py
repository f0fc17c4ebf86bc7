"""Readers and writers of the assessment's file formats.

Files are split by Spark's own text reader, so one file of any size is many
tasks. Formats whose lines depend on the lines before them are (file, line,
value) rows and windows over (file, line); records, which may hold any text, are
found in each split on its own and joined where they cross its ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sextant.scratch import written

SCHEMA_TYPES = {"BIGINT UNSIGNED": "decimal(20,0)", "BIGINT": "bigint", "INT UNSIGNED": "bigint", "INT": "int", "SMALLINT": "smallint", "TINYINT UNSIGNED": "smallint", "TINYINT": "smallint", "DATE": "date", "MEDIUMBLOB": "binary", "BLOB": "binary"}


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of text files in order within each split, ``block`` being its first byte."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines numbered from 1 in each; a final carriage return is no part of a line.

    Each split numbers its own lines, and the splits' counts, a row a split, are
    summed over the file; so a file of any size is many tasks. Empty files have no lines.
    """
    rows = split_lines(spark, path).withColumn("_row", F.monotonically_increasing_id())
    counts = rows.groupBy(F.col("file").alias("_file"), F.col("block").alias("_block")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = rows.join(counts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return joined.select("file", (F.col("_row") - F.col("_first") + F.col("_before") + 1).alias("line"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def schema_csv(spark: SparkSession, path: str) -> tuple[T.StructType, dict[str, list[str]]]:
    """The column order and types of a schema file, without ``hash``, and the columns of each storage table."""
    rows = spark.read.csv(path, header=True, inferSchema=False).collect()  # one row a column
    fields, tables = [], {}
    for r in rows:
        name, kind = r["name"].strip(), r["type"].strip().upper()
        if name == "hash":
            continue
        bare = kind.split("(")[0].replace("UNSIGNED", "").strip() + (" UNSIGNED" if "UNSIGNED" in kind else "")
        fields.append(T.StructField(name, T._parse_datatype_string(SCHEMA_TYPES.get(bare, "string"))))
        for t in (r["table"] or "base").strip().split(":"):
            tables.setdefault(t.strip(), []).append(name)
    return T.StructType(fields), tables


# -- records of one line a field --------------------------------------------------------------------


class Unfinished(ValueError):
    """The text ends within a record, which begins at ``start``."""

    def __init__(self, message: str, start: int) -> None:
        super().__init__(message)
        self.start = start


#: Bytes that go on within a character of UTF-8.
_WITHIN = bytes(range(0x80, 0xC0))
#: Bytes of records that a task holds as Python values at a time.
BATCH_BYTES = 2 << 20


def _ahead(text: bytes | bytearray, at: int, n: int) -> int | None:
    """Where ``n`` characters of UTF-8 from ``at`` end, None if there are not so many."""
    while n:
        part = text[at : at + n]
        if not part:
            return None
        at, n = at + len(part), n - len(part.translate(None, _WITHIN))
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _records(text: bytes | bytearray, fields: Sequence[str], at: int = 0, valued: bool = True) -> Iterator[tuple[int, list[str]]]:
    """(where it begins, field values) of the records from ``at`` on; no values unless ``valued``."""
    number = 0

    def line() -> bytes | bytearray | None:
        nonlocal at
        if at >= len(text):
            return None
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        out, at = text[at:end], end + 1
        return out

    def shown(found: bytes | bytearray) -> str:
        return repr(found[:160].decode("utf-8", "replace")[:40])

    def expected(token: bytes, after: str) -> None:
        found = line()
        if found is None:
            raise Unfinished(f"record {number}: ends {after}", start)
        if found != token:
            raise ValueError(f"record {number}: {token.decode()} expected {after}, {shown(found)} found")

    while (start := at) < len(text):
        token = line()
        if not token:
            continue
        number += 1
        if token != b"INSERT":
            raise ValueError(f"record {number}: INSERT expected, {shown(token)} found")
        values = []
        for name in fields:
            value = line()
            if value is None:
                raise Unfinished(f"record {number}: ends before {name}", start)
            if value == b"ENDINSERT":
                raise ValueError(f"record {number}: ends before {name}")
            if value == b"RAW":
                size = line()
                if size is None:
                    raise Unfinished(f"record {number}: ends within {name}", start)
                if not size.isdigit():
                    raise ValueError(f"record {number}: length of {name} expected, {shown(size)} found")
                end = _ahead(text, at, int(size))
                if end is None:
                    raise Unfinished(f"record {number}: ends within {name}", start)
                value, at = text[at:end] if valued else b"", end
                expected(b"ENDRAW", f"after {name}")
            if valued:
                values.append(value.decode())
        expected(b"ENDINSERT", "after its fields")
        yield start, values


def parse_records(text: str, fields: Sequence[str]) -> Iterator[list[str]]:
    """The field values of INSERT ... ENDINSERT records; ``RAW``, a length and so many characters stand for one field."""
    for _, values in _records(text.encode(), fields):
        yield values


def synchronise(text: bytes | bytearray, fields: Sequence[str], first: bool) -> tuple[int, int] | None:
    """(where records begin, where the last one is cut) of a split; None if no place fits.

    A split begins anywhere, also within a text that holds records of its own.
    Records begin at the first INSERT from which they follow one another to the
    end of the split. A file's ``first`` split begins with one, and what is wrong
    with it is left to the reader of its text. Places that one try has passed,
    a bit each, are not tried again.
    """
    start, tried = 0, bytearray(len(text) // 8 + 1)
    while True:
        try:
            for at, _ in _records(text, fields, start, False):
                tried[at >> 3] |= 1 << (at & 7)
            return start, len(text)
        except Unfinished as cut:
            return start, cut.start
        except ValueError:
            if first:
                return 0, 0
        tried[start >> 3] |= 1 << (start & 7)
        while tried[start >> 3] >> (start & 7) & 1 or not text.startswith(b"INSERT\n", start):
            start = text.find(b"\nINSERT\n", start) + 1
            if not start:
                return None


def _between(text: bytes | bytearray, fields: Sequence[str], start: int, end: int) -> Iterator[list[list[str]]]:
    """The records from ``start`` to ``end``, where :func:`synchronise` has found them, a few at a time."""
    held, since = [], start
    try:
        for at, values in _records(text, fields, start):
            if at >= end:
                break
            held.append(values)
            if at - since > BATCH_BYTES:
                yield held
                held, since = [], at
    except Unfinished:
        pass
    if held:
        yield held


def format_record(values: Sequence[str | None]) -> str:
    framed = [f"RAW\n{len(v)}\n{v}ENDRAW" if "\n" in v or v in ("RAW", "ENDINSERT") else v for v in ("" if v is None else v for v in values)]
    return "\n".join(["INSERT", *framed, "ENDINSERT", ""])


def _folded(lines: DataFrame, names: Sequence[str], whole: frozenset[tuple[str, int]] = frozenset()) -> DataFrame:
    """(file, block, synced, head, tail, fields): a row a record that lies within a split, and a row a split,
    without fields, with the lines before its first record and those of the one that is cut. With ``whole``,
    only these splits, which take no records of their own."""

    def run(batches):
        import pyarrow as pa

        def made(split: tuple[str, int], synced: bool | None, head: str | None, tail: str | None, records: list) -> pa.RecordBatch:
            n = len(records)
            of = [pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), pa.array([synced] * n, pa.bool_())]
            ends = [pa.array([x] * n, pa.string()) for x in (head, tail)]
            return pa.RecordBatch.from_arrays([*of, *ends, pa.array(records, pa.list_(pa.string()))], names=["file", "block", "synced", "head", "tail", "fields"])

        def rows(split: tuple[str, int], text: bytearray):
            found = None if whole else synchronise(text, names, split[1] == 0)
            start, end = found or (len(text), len(text))
            if start < end:
                for records in _between(text, names, start, end):
                    yield made(split, None, None, None, records)
            yield made(split, found is not None, text[:start].decode(), text[end:].decode(), [None])

        split, held = None, bytearray()  # a split's bytes: as text, one wide character would take four bytes of each
        for batch in batches:
            files, blocks, values = (batch.column(i) for i in range(3))
            files, blocks = files.to_pylist(), blocks.to_pylist()
            at = 0
            while at < len(files):  # splits are not mixed within a task
                stop = at + 1
                while stop < len(files) and blocks[stop] == blocks[at] and files[stop] == files[at]:
                    stop += 1
                if (files[at], blocks[at]) != split:
                    if split and held:
                        yield from rows(split, held)
                    split, held = (files[at], blocks[at]), bytearray()
                if not whole or split in whole:
                    for value in values.slice(at, stop - at).cast(pa.binary()).to_pylist():
                        held += value
                        held += b"\n"
                at = stop
        if split and held:
            yield from rows(split, held)

    return lines.mapInArrow(run, "file string, block long, synced boolean, head string, tail string, fields array<string>")


def _joined(splits: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file, block, after, state, message, records) of the texts between the records of neighbouring splits.

    Such a text goes from the cut record of one split, ``block``, to where records
    begin in the next one that knows, ``after`` (null: to the end of the file).
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    own = F.when(F.col("synced"), F.col("block"))
    placed = splits.withColumns({"_from": F.last(own, True).over(before), "_to": F.first(own, True).over(after)})
    heads = placed.where("head <> ''").select("file", F.col("_from").alias("of"), "block", F.col("head").alias("part"))
    tails = placed.where("synced").select("file", F.col("block").alias("of"), "block", F.col("tail").alias("part"), "_to")
    texts = tails.unionByName(heads, allowMissingColumns=True).groupBy("file", "of").agg(F.max("_to").alias("after"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                try:
                    out.append(("whole", None, list(parse_records(text, names))))
                except Unfinished as e:
                    out.append(("cut", str(e), []))
                except ValueError as e:
                    out.append(("wrong", str(e), []))
            made = [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], names=["file", "block", "after", "state", "message", "records"])

    return texts.mapInArrow(run, "file string, block long, after long, state string, message string, records array<array<string>>")


def _typed(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.unhex(value) if isinstance(kind, T.BinaryType) else value
    return F.nullif(value, F.lit("")).cast(kind)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of record files with the types of ``schema``, in splits of ``spark.sql.files.maxPartitionBytes``.

    Each split takes the records that lie in it, from where they first follow one
    another; the text between two splits' records must then be whole records,
    which proves, from a file's start on, that all of them began in the right
    place. A split that took records out of another record's text leaves its
    neighbour's cut; it gives its records up and is read as part of that text,
    twice as many splits each time. A task holds a split or such a text. Splits
    are read once and written to the shared folder. Files must end with a whole
    record; a wrong token or an early end raises ValueError. An empty field is
    null, but in text and binary columns.
    """
    names = schema.fieldNames()
    folded = written(_folded(split_lines(spark, path), names))
    own = folded.where("synced is not null").select("file", "block", "synced", "head", "tail")
    splits, given_up, several = own, frozenset(), 1
    while True:
        found = written(_joined(splits, names))
        first = found.where("state <> 'whole'").groupBy("file").agg(F.min_by(F.struct("block", "after", "state", "message"), "block").alias("f"))
        if stop := first.where("f.state = 'wrong' or f.after is null").first():
            raise ValueError(f"{stop.file}, from the split at byte {stop.f.block}: {stop.f.message}")
        order = Window.partitionBy("file").orderBy("block")  # a row a split
        more = splits.join(first, "file").where("synced and block >= f.after").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= several)
        more = [tuple(r) for r in more.select("file", "block").collect()]  # as many splits as the task that reads their text will hold
        if not more:
            break
        given_up, several = given_up.union(more), 2 * several
        texts = written(_folded(split_lines(spark, path), names, given_up)).drop("fields")
        splits = own.join(texts, ["file", "block"], "left_anti").unionByName(texts)
    within = folded.where("fields is not null")
    if given_up:
        within = within.join(spark.createDataFrame(sorted(given_up), "file string, block long"), ["file", "block"], "left_anti")
    rows = within.select("fields").union(found.select(F.explode("records").alias("fields")))
    values = [F.get("fields", F.lit(i)) for i in range(len(names))]
    return rows.select(*[_typed(v, f.dataType).alias(f.name) for v, f in zip(values, schema.fields, strict=True)])


def write_records(rows: DataFrame, path: str, rows_per_file: int = 1000) -> None:
    """Record files of at most ``rows_per_file`` rows, each task its own; binary values as hex."""
    shown = [F.lower(F.hex(c)) if k == "binary" else F.col(c).cast("string") for c, k in rows.dtypes]
    text = [F.coalesce(s, F.lit("")) for s in shown]
    framed = [F.when(t.contains("\n") | t.isin("RAW", "ENDINSERT"), F.concat(F.lit("RAW\n"), F.length(t).cast("string"), F.lit("\n"), t, F.lit("ENDRAW"))).otherwise(t) for t in text]
    rows.select(F.concat_ws("\n", F.lit("INSERT"), *framed, F.lit("ENDINSERT")).alias("value")).write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").text(path)


class LineRecords(DataSource):
    """``spark.read.format("linerecords")`` and ``df.write.format("linerecords")``: the same rows as a named source.

    ``paths`` and ``path`` are folders, files or URIs that all executors see.
    Reading takes a file as a partition; ``read_records`` splits files.
    """

    @classmethod
    def name(cls) -> str:
        return "linerecords"

    def schema(self) -> str:
        return self.options["fields"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options.get("paths", self.options.get("path", "")).split(","), schema.fieldNames())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("rowsPerFile", "1000")), overwrite)


def _at(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """A path that is a file, or the files of a folder that are rows: none whose name begins with ``_`` or a point."""
    from pyarrow.fs import FileSelector, FileType

    fs, at = _at(path)
    if fs.get_file_info(at).type != FileType.Directory:
        return [at]
    found = fs.get_file_info(FileSelector(at))
    return sorted(f.path for f in found if f.type == FileType.File and not f.base_name.startswith(("_", ".")))


class _Path(InputPartition):
    def __init__(self, root: str, path: str) -> None:
        self.root, self.path = root, path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]) -> None:
        self.paths, self.names = paths, names

    def partitions(self) -> list[InputPartition]:
        return [_Path(p, f) for p in self.paths for f in _files(p)]

    def read(self, partition: _Path) -> Iterator[tuple]:
        with _at(partition.root)[0].open_input_stream(partition.path) as f:
            yield from map(tuple, parse_records(f.read().decode(), self.names))


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class _Writer(DataSourceWriter):
    """Writes in two phases: tasks write files of their own into a folder of the job below ``path``, and only
    the files of the tries that Spark commits are moved to ``path``. So a task that fails, or runs twice,
    leaves no rows; with ``overwrite`` the files before go when the new ones are whole."""

    def __init__(self, path: str, rows_per_file: int, overwrite: bool) -> None:
        import uuid

        self.path, self.rows_per_file, self.overwrite = path, rows_per_file, overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid
        from itertools import batched

        fs, root = _at(self.path)
        fs.create_dir(f"{root}/{self.job}")
        made = []
        for part in batched(rows, self.rows_per_file):
            made.append(f"part-{uuid.uuid4().hex}")
            with fs.open_output_stream(f"{root}/{self.job}/{made[-1]}") as out:
                for row in part:
                    out.write(format_record([None if v is None else v.hex() if isinstance(v, bytes | bytearray) else str(v) for v in row]).encode())
        return _Written(made)

    def commit(self, messages: list) -> None:
        fs, root = _at(self.path)
        fs.create_dir(root)
        before = _files(self.path) if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        for old in before:
            fs.delete_file(old)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


def split_tables(rows: DataFrame, tables: dict[str, list[str]], key: str = "id", hashed: bool = False) -> dict[str, DataFrame]:
    """Each storage table's columns, with the key; with ``hashed`` a table of row hashes besides."""
    from sextant.functions.scalars import row_hash

    out = {t: rows.select(*dict.fromkeys([key, *cs])) for t, cs in tables.items()}
    if hashed:
        out["row_hashes"] = rows.select(key, row_hash(*[F.col(c) for c in rows.columns if c != key]).alias("hash"))
    return out


# -- learning sources --------------------------------------------------------------------------------


def census(lines: DataFrame, household: dict[str, tuple[int, int]], person: dict[str, tuple[int, int]]) -> DataFrame:
    """Person rows of a fixed-width file with the fields of the household line before them.

    Fields are (first, last) characters from 1; a person's weight is characters
    12-16, and weight 0 is left out.
    """
    cut = lambda spec: [F.substring("value", a, b - a + 1).alias(n) for n, (a, b) in spec.items()]
    head = F.when(F.substring("value", 1, 1) == "H", F.struct(*cut(household)))
    last = F.last(head, True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("_h", last).where(F.substring("value", 1, 1) == "P")
    out = rows.select("file", "line", *[F.col(f"_h.{n}").alias(n) for n in household], *cut(person), F.substring("value", 12, 5).try_cast("int").alias("weight"))
    return out.where("weight > 0")


def name_frequencies(lines: DataFrame) -> DataFrame:
    """(name, weight): weight is the percentage times 1000 plus 1."""
    pattern = r"([A-Z]+) *(\d\.\d\d\d)"
    rows = lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("name"), F.round(F.regexp_extract("value", pattern, 2).cast("decimal(6,3)") * 1000 + 1).cast("long").alias("weight"))
    return rows.groupBy("name").agg(F.sum("weight").alias("weight"))


def conditional_counts(rows: DataFrame, given: Sequence[str], value: str, state: str | None = None) -> DataFrame:
    """(given..., value, weight); spaces in the state become underscores."""
    if state:
        rows = rows.withColumn(state, F.regexp_replace(state, " ", "_"))
    return rows.groupBy(*given, value).agg(F.count("*").alias("weight"))


def zip_codes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(state, zip, weight) and (zip, city, weight) of CSV files with columns ``zip code``, ``state`` and ``city``."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True).select(F.col("zip code").alias("zip"), "state", "city")
    return conditional_counts(rows, ["state"], "zip", "state"), conditional_counts(rows, ["zip"], "city")


def streets(spark: SparkSession, path: str) -> DataFrame:
    """(zip, street, weight) of CSV files with columns ``zip`` and ``fullname``."""
    return conditional_counts(spark.read.csv(path, header=True).select("zip", F.col("fullname").alias("street")), ["zip"], "street")


# -- resource metrics -----------------------------------------------------------------------------------


def collectl(lines: DataFrame, pattern: str, stamp: str = "yyyyMMdd HH:mm:ss") -> DataFrame:
    """(file, time, unit, metric, value) of a wide collector log.

    The header line begins with ``#Date``; ``pattern`` takes unit and metric out of
    a column's name, as ``\\[CPU:(\\d+)\\](.*)`` does. Columns without a match are left out.
    """
    head = F.last(F.when(F.col("value").startswith("#Date"), F.col("value")), True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("_head", F.split(head, r"[ ,]+")).where(~F.col("value").startswith("#") & F.col("_head").isNotNull() & (F.trim("value") != ""))
    cells = rows.select("file", "line", F.split("value", r"[ ,]+").alias("v"), F.posexplode("_head").alias("k", "name"))
    time = F.to_timestamp(F.concat_ws(" ", F.get("v", F.lit(0)), F.get("v", F.lit(1))), stamp)
    out = cells.where(F.col("name").rlike(pattern)).select("file", time.alias("time"), F.regexp_extract("name", pattern, 1).alias("unit"), F.regexp_extract("name", pattern, 2).alias("metric"), F.get("v", F.col("k")).try_cast("double").alias("value"))
    return out


def packets_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("time double, direction string, payloadlength long, protocol string").csv(path, header=True)


def tcpdump(lines: DataFrame) -> DataFrame:
    """(file, time, length, source, target): records of two lines each, the second indented."""
    following = F.lead("value").over(Window.partitionBy("file").orderBy("line"))
    rows = lines.withColumn("_next", following).where(F.col("value").rlike(r"^\d") & F.coalesce(F.col("_next"), F.lit("")).rlike(r"^\s"))
    ends = r"^\s+(\S+) > ([^:\s]+)"
    return rows.select("file", F.regexp_extract("value", r"^([\d.:]+)", 1).alias("time"), F.regexp_extract("value", r"length (\d+)", 1).try_cast("long").alias("length"), F.regexp_extract("_next", ends, 1).alias("source"), F.regexp_extract("_next", ends, 2).alias("target"))


#: Names that test-run files use for a key.
RUN_KEYS = {"test_script": "testname", "disjunction_ratio": "disjunction_prob", "match_rate": "unique_matches", "publication_timeout": "pub_wait"}


def test_runs(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each run (file) with the values of ``key = value`` lines; different values join by ``?``.

    Keys may go by the names of ``RUN_KEYS``. A value ``~v`` gives way to one
    whose second word is v, and values of keys with ``prob`` are equal as numbers.
    """
    pattern = r"^\s*([A-Za-z_][\w ]*?)\s*[=:]\s*(.*?)\s*$"
    names = F.create_map(*[F.lit(x) for pair in RUN_KEYS.items() for x in pair])
    rows = lines.select("file", F.lower(F.regexp_extract("value", pattern, 1)).alias("key"), F.regexp_extract("value", pattern, 2).alias("v")).where("key <> ''")
    rows = rows.withColumn("key", F.coalesce(F.element_at(names, F.col("key")), F.col("key")))
    number = F.when(F.col("key").contains("prob"), F.col("v").try_cast("double"))
    values = rows.groupBy("file", "key", F.coalesce(number.cast("string"), F.col("v")).alias("_as")).agg(F.min("v").alias("v"))
    every = values.groupBy("file", "key").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    kept = F.filter("vs", lambda a: ~(a.startswith("~") & F.exists("vs", lambda b: F.get(F.split(b, r"\s+"), F.lit(1)) == F.substr(a, F.lit(2)))))
    return every.select("file", "key", F.array_join(kept, "?").alias("v")).groupBy("file").pivot("key", list(keys)).agg(F.first("v"))


# -- tables ------------------------------------------------------------------------------------------------


def normalised(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as the types of a results table: text, integer, real, bool, or list (pipe text)."""
    from sextant.functions.scalars import from_pipes, normal_bool, normal_null

    def typed(c: str) -> Column:
        kind, raw = kinds.get(c, "text"), normal_null(F.col(c))
        return {"integer": raw.try_cast("bigint"), "real": raw.try_cast("double"), "bool": normal_bool(F.col(c)), "list": from_pipes(F.col(c))}.get(kind, raw).alias(c)

    return rows.select(*[typed(c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header; lists as pipe text."""
    shown = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if k.startswith("array") else F.col(c) for c, k in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").csv(path, header=True)
