"""Near-duplicate documents by BagMinHash.

A document is the multiset of its word shingles. Each shingle runs a Poisson
process over its discretised weight: one process for the levels [0, 1), [1, 2),
[2, 4), [4, 8) and so on, whose rate is the interval's width; a point's level
inside its interval comes from halving it again and again, one hash bit a
halving, and points above the shingle's weight are left out. Each point falls
into a random signature component, which keeps its earliest point. Two
documents agree in a component with exactly the probability of their weighted
Jaccard similarity. Points come in ascending order, so a process stops once it
is later than every component's earliest point.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._neardup import STEP, Hashes, Same, classes, components, mixed, shingles, stars
from ._shared import col, cut, fresh, scan, table
from .line_dedup import handle

WORDS, SIMILARITY = 5, 0.8
#: Components of a signature; bands of BAND_ROWS of them. At similarity 0.8 a pair shares a band with probability 0.998.
SIZE, BANDS, BAND_ROWS = 128, 21, 6


def multiset(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) in order, with their multiplicities."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n_rows: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures, one row of ``size`` floats for each row; infinite where a row is empty."""
    if not 0 < size <= 2048:
        raise ValueError("11 bits choose the component")
    out = np.full(n_rows * size, np.inf)
    # one process for each interval that the weight reaches into: [0, 1), then [2^(k-1), 2^k)
    n = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(row)), n)
    k = np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    width = np.maximum(low, 1)
    row, weight = row[element], weight[element]
    state = mixed(value[element] ^ mixed(k.astype(np.uint64) * STEP + np.uint64(1)))
    time = np.zeros(len(row))
    full = np.zeros(n_rows, bool)
    last = np.full(n_rows, np.inf)
    while len(row):
        points = max(1, min(64, 16384 // len(row)))
        states = state[:, None] + np.arange(1, points + 1, dtype=np.uint64) * STEP
        random = mixed(states)
        wait = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        times = np.cumsum(np.concatenate([time[:, None], wait], axis=1), axis=1)[:, 1:]
        level = low[:, None]
        if (width > 1).any():
            bits = mixed(random ^ STEP)  # its highest bits are the halvings
            level = level + (bits >> np.uint64(32)).astype(np.int64) * width[:, None] // (1 << 32)
        good = (level < weight[:, None]) & (times < last[row][:, None])
        at = (row[:, None] * size + (random & np.uint64(0x7FF)).astype(np.int64) * size // 2048)[good]
        np.minimum.at(out, at, times[good])
        touched = np.unique(row)
        last[touched] = out.reshape(n_rows, size)[touched].max(axis=1)
        state, time = states[:, -1], times[:, -1]
        going = time < last[row]
        row, weight, low, width, state, time = (x[going] for x in (row, weight, low, width, state, time))
    return out.reshape(n_rows, size)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit hashes of ``rows`` components each."""
    raw = signature[:, : bands * rows].copy().view(np.uint64).reshape(len(signature), bands, rows)
    value = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        value = mixed(value * STEP + raw[:, :, k])
    return value.view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=16).digest()


class Overlap(Same):
    """Weighted Jaccard similarity of the shingle multisets, exactly."""

    def __init__(self, size: int = WORDS, least: float = SIMILARITY) -> None:
        self.size, self.least, self.hashes = size, least, Hashes()

    def prepare(self, item: str) -> tuple[np.ndarray, np.ndarray, int]:
        words = np.fromiter(map(self.hashes.__getitem__, words_of(item)), np.uint64)
        row, value = shingles(words, np.array([0]), np.array([len(words)]), self.size)
        _, value, n = multiset(row, value)
        return value, n, int(n.sum())

    def same(self, a: tuple, b: tuple) -> bool:
        (va, na, ta), (vb, nb, tb) = (a, b) if a[2] <= b[2] else (b, a)
        if ta < self.least * tb:
            return False
        at = np.minimum(np.searchsorted(vb, va), max(len(vb) - 1, 0))
        both = int(np.minimum(na, nb[at])[vb[at] == va].sum()) if len(va) and len(vb) else 0
        return both >= self.least * (ta + tb - both) if ta or tb else True


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WORDS) -> DataFrame:
    """(id, handle, row, key, bands): a handle of id and text, a row number, a digest of the words, and the band hashes of every row."""

    def make() -> Callable:
        hashes = Hashes()

        def run(texts: list[str | None]) -> list:
            rows = [words_of(t) for t in texts]
            ends = np.cumsum([len(r) for r in rows])
            words = np.fromiter((hashes[w] for r in rows for w in r), np.uint64, int(ends[-1]))
            row, value, weight = multiset(*shingles(words, ends - [len(r) for r in rows], ends, size))
            bands = band_hashes(signatures(row, value, weight, len(rows)), BANDS, BAND_ROWS)
            some = np.array([bool(r) for r in rows])
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel()))
            return [[digest(r) for r in rows], listed]

        return run

    narrow = docs.select(col(id_col).alias("id"), handle(id_col, text).alias("handle"), col(text).alias("text"))
    out = scan(narrow, "text", ("id", "handle"), [("key", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))], make, 1 << 20)  # shingles take some 50 times their text
    return out.select("id", "handle", F.monotonically_increasing_id().alias("row"), "key", "bands")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY, size: int = WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, ``class_id`` (the smallest id of its class), ``class_size``, ``kept``.

    A class is a component of documents with a weighted Jaccard similarity of
    ``least`` or more over ``size``-word shingles (lower case, white space as one
    space); exact copies are joined before anything else, so a group of copies is
    one document in all later steps. One row of each class is kept: that of the
    smallest id, and of repeated rows one. Texts without words (null, empty,
    blank) are copies of each other. Null ids come after all others and are never
    a class id unless the class has no other. Other columns are not read.
    """
    rows = cut(features(docs, id_col, text, size))
    return _classify(rows, docs, id_col, text, least, size).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def _classify(rows: DataFrame, docs: DataFrame, id_col: str, text: str, least: float, size: int) -> DataFrame:
    place = F.struct(F.col("id").isNull().alias("z"), "id", "row", "handle")
    copies = cut(rows.groupBy("key").agg(F.min(place).alias("p"), F.count("*").alias("n"), F.any_value("bands").alias("bands")).select("key", F.col("p.row").alias("node"), F.col("p.id").alias("id"), F.col("p.handle").alias("handle"), "n", "bands"))
    candidates = components(stars(copies.select("node", F.explode("bands").alias("bucket"))))
    named = cut(candidates.join(copies.select("node", "key", "id", "handle"), "node"))
    # by id and text, so that rows with one id, or none, do not all meet each other; both sides
    # grow with the corpus: the same join at every size
    texts = docs.select(handle(id_col, text).alias("own"), col(id_col).alias("own_id"), col(text).alias("item"))
    members = texts.hint("merge").join(named, (texts["own"] == named["handle"]) & texts["own_id"].eqNullSafe(named["id"])).select("node", "comp", "key", "item")
    members = cut(_checked(members).dropDuplicates(["node"]))
    joint = classes(members, lambda: Overlap(size, least))
    nodes = copies.join(joint, "node", "left").select("key", "n", F.coalesce("comp", "node").alias("comp"), F.struct(F.col("id").isNull().alias("z"), "id", F.col("node").alias("row")).alias("p"))
    best = nodes.groupBy("comp").agg(F.min("p").alias("best"), F.sum("n").alias("class_size"))
    by_key = nodes.select("key", "comp").join(best, "comp").select("key", "best", "class_size")
    return rows.select("id", "row", "key").join(by_key, "key").select("id", "key", F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))


def _checked(members: DataFrame) -> DataFrame:
    """Only rows whose text has the key, where several rows share an id."""

    def run(batches):
        for batch in batches:
            keys, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [digest(words_of(t)) == k for k, t in zip(keys, items, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["node", "comp", "item"])

    return members.mapInArrow(run, "node long, comp long, item string")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document, and the one document of each class that stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; of repeated rows one."""
    kept = _classify(cut(features(docs)), docs, "doc_id", "text", SIMILARITY, WORDS).where("kept").select("key", F.xxhash64("id").alias("own"))
    key, own = fresh("key", docs.columns), fresh("own", docs.columns)
    keyed = scan(docs, "text", docs.columns, [(key, T.BinaryType())], lambda: lambda texts: [[digest(words_of(t)) for t in texts]])
    kept = kept.toDF(key, own)
    # a hot text's copies have different ids, so they come to different tasks
    joined = keyed.withColumn(own, F.xxhash64(col("doc_id"))).join(kept, [key, own])
    return joined.dropDuplicates([key, own]).select(*[col(c) for c in docs.columns])


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
SQL: dict[str, str] = {}
