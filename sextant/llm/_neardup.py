"""Links between near duplicates: bucket stars, components, verification in blocks.

All of it stays linear in the rows: a bucket of n rows gives n - 1 edges to its
smallest row, and verification looks for links that join components, not for
every pair of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._shared import cut, discard

#: Rows of either side in a block of verification.
BLOCK = 256


def stars(rows: DataFrame, bucket: str = "bucket", node: str = "node") -> DataFrame:
    """Edges (a, b) from each row of a bucket to its smallest node.

    Takes one shuffle of (bucket, node); a large bucket is a stream of two
    numbers a row in one task, spilled beyond a few thousand.
    """
    least = F.min(node).over(Window.partitionBy(bucket))
    return rows.select(node, least.alias("least")).where(F.col(node) != F.col("least")).select(F.col(node).alias("a"), F.col("least").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b); comp is the smallest node of its component.

    Large-star and small-star steps in turn until all edges are stars. Each step
    gives a node one edge for each of its neighbours at most, so no neighbourhood
    is gathered anywhere; each round is written to the shared folder.
    """

    def star(sym: DataFrame) -> DataFrame:
        return sym.groupBy("a").agg(F.min("b").alias("m"))

    def settled(e: DataFrame) -> bool:
        """Whether every node has one edge as a child, or some as a root, not both."""
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(e.select("b", F.lit(0), F.lit(1)))
        mixed_up = ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 or (c = 1 and r = 1)")
        return mixed_up.isEmpty()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not settled(now):
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        large = both.join(star(both).select("a", F.least("a", "m").alias("m")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(star(large), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(star(large).select("a", F.col("m").alias("b"))).where("a != b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = cut(small)
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct())


class Same:
    """How two items are compared; ``prepare`` runs once an item, ``same`` once a pair."""

    def prepare(self, item):
        return item

    def same(self, a, b) -> bool:
        raise NotImplementedError


def verified(members: DataFrame, same: Callable[[], Same]) -> DataFrame:
    """Edges (a, b) between members (node, comp, item) that are the same, enough of
    them to connect what is connected within each candidate component.

    First each member is held against its component's smallest node. Members that
    differ from it are then held against all other members, in blocks of BLOCK by
    BLOCK rows, until each has met every member that it is not yet joined with. So
    a component of copies costs one comparison a member, and no link between
    different items is lost however large it is. A null item equals nothing.
    """
    members = members.select("node", "comp", "item")
    centres = members.where("node = comp").select("comp", F.col("item").alias("centre"))
    near = members.where("node != comp").join(centres, "comp").select("node", "comp", "item", "centre")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, at, centre = same(), None, None
        for batch in batches:
            nodes, comps, items, centres = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for comp, item, other in zip(comps, items, centres, strict=True):
                if comp != at:
                    at, centre = comp, None if other is None else how.prepare(other)
                good.append(item is not None and centre is not None and how.same(how.prepare(item), centre))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(comps, pa.int64()), pa.array(good, pa.bool_())], names=["node", "comp", "good"])

    first = cut(near.mapInArrow(held, "node long, comp long, good boolean"))
    joined = first.where("good").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    counts = first.groupBy("comp").agg(F.count("*").alias("n"), F.count(F.when(~F.col("good"), 1)).alias("n_left")).where("n_left > 0 and n > 1")
    counts = counts.select("comp", F.ceil(F.col("n_left") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("others"))
    rest = first.join(counts, "comp").join(members.select("node", "item"), "node")
    part = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rest = cut(rest.select("node", "comp", "good", "item", "parts", "others"))
    left = rest.where("not good").select("node", "comp", "item", "good", F.lit(True).alias("own"), part("parts", 1).alias("part"), spread("others").alias("other"))
    right = rest.select("node", "comp", "item", "good", F.lit(False).alias("own"), spread("parts").alias("part"), part("others", 2).alias("other"))

    def block(group: pa.Table) -> pa.Table:
        how = same()
        node, item, good, own = (group.column(c).to_pylist() for c in ("node", "item", "good", "own"))
        ready: dict = {}
        for n, x in zip(node, item, strict=True):
            if x is not None and n not in ready:
                ready[n] = how.prepare(x)
        root = {n: n for n in ready}

        def find(n):
            while root[n] != n:
                root[n] = n = root[root[n]]
            return n

        joint = [n for n, g, o in zip(node, good, own, strict=True) if g and not o and n in ready]
        for n in joint[1:]:  # all of them are joined through the smallest node
            root[n] = joint[0]
        a, b = [], []
        against = [n for n, o in zip(node, own, strict=True) if not o and n in ready]
        for n in (n for n, o in zip(node, own, strict=True) if o and n in ready):
            for m in against:
                if n != m and (x := find(n)) != (y := find(m)) and how.same(ready[n], ready[m]):
                    root[x] = y
                    a.append(n)
                    b.append(m)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = left.unionByName(right).groupBy("comp", "part", "other").applyInArrow(block, "a long, b long")
    return joined.union(blocks)


def classes(members: DataFrame, same: Callable[[], Same]) -> DataFrame:
    """(node, comp) of the members that are in a verified component with others."""
    return components(verified(members, same))


# -- words and shingles -----------------------------------------------------------------------------

MIX_A, MIX_B, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Words to 64-bit hashes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


def shingles(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``size``-word shingle of rows ``words[starts:ends]``.

    A row with fewer words is one shingle of all its words; one without words has none.
    """
    lengths = ends - starts
    n = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(starts)), n)
    at = np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    value = np.zeros(len(row), np.uint64)
    if (lengths >= size).all():
        for k in range(size):
            value = mixed(value * STEP + words[at + k])
    elif len(row):
        short, stop = np.repeat(lengths, n) < size, np.repeat(ends, n)
        for k in range(size):
            inside = ~short | (at + k < stop)
            word = words[np.minimum(at + k, len(words) - 1)]
            value = np.where(inside, mixed(value * STEP + word), value)
    return row, value
