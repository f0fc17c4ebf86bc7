"""What the training-data operators share: text scans, scratch tables, ids."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task holds as Python strings at a time.
SLICE_BYTES = 4 << 20
#: Whether a write or query deletes its shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name`` with as many underscores as no name in ``taken`` has."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none in local mode, as in tests, a temporary
    folder is made and remembered in the session; on a cluster none would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("sextant.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("sextant.scratch.dir", found)
    return found


def cut(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    The copy is Parquet, so later reads prune columns, and a lost executor
    costs only the tasks that it ran. Without ``dictionary`` no column is tried
    for one, which costs much where most values are hashes. The shuffles of the
    write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sextant-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``; only for frames that nothing reads again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives its free memory back at the end: workers stay beside the tasks of later steps."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return inner


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``limit`` bytes in ``column`` each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def scan(
    df: DataFrame,
    value: str,
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list], Sequence]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Row-wise Arrow scan: ``keep`` columns, then ``fields`` computed from column ``value``.

    ``make()`` runs once in each task and returns ``f(values) -> one sequence per
    field``. Columns travel under positional names, so nothing in ``df`` can
    clash with anything here, and only the named columns are read. ``f`` gets about
    ``limit`` bytes of text at a time.
    """
    narrow = df.select(col(value).alias("v"), *[col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    names = [f"k{i}" for i in range(len(keep))] + [f"f{i}" for i in range(len(fields))]
    schema = T.StructType(
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
        + [T.StructField(f"f{i}", kind) for i, (_, kind) in enumerate(fields)]
    )
    kinds = [kind for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types, f = [to_arrow_type(k) for k in kinds], make()
        for batch in batches:
            for part in slices(batch, 0, limit):
                made = f(part.column(0).to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *arrays], names=names)

    out = narrow.mapInArrow(lean(run), schema)
    return out.toDF(*keep, *[n for n, _ in fields])
