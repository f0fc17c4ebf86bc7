"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Whether a write or query deletes its shuffles when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sextant.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("sextant.scratch.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost executor costs its own tasks only.
    The shuffles of the write go with its end, as nothing reads them again."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/sextant-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table in the shared folder in as many buckets of ``keys`` as the session has shuffle partitions, so that
    joins on them do not shuffle it, and a function that drops it, files and all, once nothing reads it."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"sextant_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.table(name), drop


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name`` with as many underscores as no name in ``taken`` has."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
