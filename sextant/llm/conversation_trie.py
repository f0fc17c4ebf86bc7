"""Conversation prefix trie: which conversations begin alike, and what sharing the beginnings saves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import col, cut, discard, table
from ._sorted import in_order

#: Bytes of a turn's digest, and conversations in a forest.
DIGEST, FOREST = 16, 4096
#: Conversations take their first turns from the first of so many ids; one of so many numbers of turns.
FAMILY, HEADS = 5, 9

NODE = (
    "block long, node int, parent int, open boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, ends string"
)
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (digest, bytes of the text).

    Turns go by number, null first, then by role and digest; repeated rows are
    repeated turns. Null roles and texts are empty. Rows without a conversation
    belong to none and are left out. Texts stay where they are: a conversation
    is gathered as 32 characters and a number for each turn.
    """
    r, x = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, x))
    turns = df.where(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv_id"), F.struct(col(turn).alias("t"), r.alias("r"), digest.alias("d"), F.octet_length(x).cast("long").alias("b")).alias("x")
    )
    ordered = F.sort_array(F.collect_list("x"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["d"].alias("d"), t["b"].alias("b"))).alias("turns"))


def heads(conv: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(found: DataFrame) -> DataFrame:
    """(conv_id, turns) with each conversation's first turns taken from the first conversation of its family.

    Where that conversation has fewer turns, all of them are taken; where it is
    missing, none. A conversation may be left without turns.
    """
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    first = found.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = heads(F.col("conv_id")).cast("int")
    none = F.array().cast(found.schema["turns"].dataType)
    taken = F.when(h > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest(h, F.lit(1)))).otherwise(none)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return found.withColumn("base", base).join(first, "base", "left").select("conv_id", F.concat(taken, own).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many whole digests two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """The trie of consecutive sorted sequences.

    ``before`` and ``after`` are the sequences next to them in the whole order.
    Nodes that those share are open: what is counted for them here is a part,
    and the parts of all forests add up. The forest where an open node begins
    counts it once for its parent and its saving, the one where it ends decides
    whether it is childless.
    """

    def __init__(self, convs: Sequence[int], keys: Sequence[bytes], sizes: Sequence[Sequence[int]], before: bytes | None, after: bytes | None):
        self.convs, self.keys, self.sizes = convs, keys, sizes
        self.lengths = [len(k) // DIGEST for k in keys]
        self.left = -1 if before is None else shared_turns(before, keys[0])
        self.right = -1 if after is None else shared_turns(keys[-1], after)
        self.last = len(keys) - 1
        self.nodes: list[list] = []  # low row, depth, least conversation, conversations, children, leaves, saved, ends, parent, open
        self._build()

    def _build(self) -> None:
        n = len(self.keys)
        edges = np.array([shared_turns(self.keys[i], self.keys[i + 1]) for i in range(n - 1)], np.int64)
        root = list(range(n))
        #: By component: low row, high row, depth of its top, least conversation, conversations, children, leaves, saved, ends, nodes below the top
        tops = [[i, i, self.lengths[i], self.convs[i], 1, 0, 0, 0, 1, []] for i in range(n)]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i in np.argsort(-edges, kind="stable").tolist():
            depth, a, b = int(edges[i]), find(i), find(i + 1)
            x, y = tops[a], tops[b]
            self._lift(x, depth)
            self._lift(y, depth)
            x[1], x[3] = y[1], min(x[3], y[3])
            for k in (4, 5, 6, 7, 8):
                x[k] += y[k]
            if len(x[9]) < len(y[9]):
                x[9], y[9] = y[9], x[9]
            x[9] += y[9]
            root[b], tops[b] = a, []
        self._lift(tops[find(0)], -1)

    def _lift(self, top: list, depth: int) -> None:
        """Close the top node and those above it that have one child, down to ``depth``."""
        low, high, at, least, n, children, leaves, saved, ends, below = top
        while at > depth:
            begins = low > 0 or at > self.left
            closed_right = high < self.last or at > self.right
            if closed_right and self.lengths[high] == at:
                leaves += 1
            if at:
                saved += (n - begins) * self.sizes[low][at - 1]
            me = len(self.nodes)
            self.nodes.append([low, at, least, n, children, leaves, saved, ends, -1, not (begins and closed_right)])
            for child in below:
                self.nodes[child][8] = me
            below, children, ends, at = [me], int(begins), 0, at - 1
        top[2], top[5], top[6], top[7], top[8], top[9] = at, children, leaves, saved, ends, below

    def rows(self, block: int) -> dict[str, list]:
        out: dict[str, list] = {name.split()[0]: [] for name in NODE.split(", ")}
        prefix: dict[tuple[int, int], bytes] = {}
        nothing = hashlib.sha256(b"").hexdigest()

        def key(node: int) -> bytes | None:
            if node < 0 or not self.nodes[node][9]:
                return None
            low, depth = self.nodes[node][:2]
            if (low, depth) not in prefix:  # from the longest prefix of that row that is open
                running = hashlib.blake2b(digest_size=DIGEST)
                top = max(self.left, self.right)
                for d in range(min(top, self.lengths[low]) + 1):
                    prefix[low, d] = running.copy().digest()
                    running.update(self.keys[low][d * DIGEST : (d + 1) * DIGEST])
            return prefix[low, depth]

        for i, (low, depth, least, n, children, leaves, saved, ends, parent, is_open) in enumerate(self.nodes):
            named = ",".join(map(str, self.convs[low : low + ends])) if ends else ""
            up = self.nodes[parent] if parent >= 0 else None
            values = (
                block, i, parent, is_open, depth, least, up[2] if up and not up[9] else None, n, children, leaves, saved,
                None if is_open else hashlib.sha256(named.encode()).hexdigest() if named else nothing, key(i), key(parent) if is_open else None, named if is_open else None,
            )
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)
        return out


def forests(size: int = FOREST) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes of every forest of ``size`` sequences in the parts that ``in_order`` gives; a forest is numbered by its part and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, NODE.split(", "))])
        held: list[tuple[int, bytes, list[int]]] = []
        part, place, before = None, 0, None

        def made(after: bytes | None) -> Iterator[pa.RecordBatch]:
            nonlocal held, place, before
            if held:
                convs, keys, sizes = zip(*held, strict=True)
                yield pa.RecordBatch.from_pydict(Forest(convs, keys, sizes, before, after).rows((part << 32) + place), schema=schema)
                before, held, place = keys[-1], [], place + 1

        for batch in batches:
            for p, side, key, conv, sizes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if p != part:
                    yield from made(None)
                    part, place, before = p, 0, None
                if side < 0:
                    before = key
                elif side > 0:
                    yield from made(key)
                else:
                    if len(held) == size:
                        yield from made(key)
                    held.append((conv, key, sizes))
        yield from made(None)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a key of its rows' texts in order, joined by commas, as they stream by."""
    key, running = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if running is not None:
                    yield out()
                key, running = k, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
    if running is not None:
        yield out()


def prefix_trie(found: DataFrame, forest: int = FOREST) -> DataFrame:
    """One row for each distinct beginning of the conversations ``found`` (conv_id, turns), as ``sequences`` gives them.

    Columns are conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes at or below it),
    saved_tokens (bytes of last texts not repeated thanks to sharing, at or
    below it) and ends_sha256 (digest of the ids that end here).

    Conversations are sorted by their digests and cut into forests of bounded
    size. In a forest the edges between neighbours are taken by falling number
    of shared turns; each joins two components by union-find at a branching
    node, and the nodes above a component with one child each are its chain.
    Nodes that reach over a forest's edge are contracted to a partial row and
    added up by the digest of their beginning; only those rows and the forests'
    edges meet again. No conversations give no rows. Conversations without turns
    are members of the root. Equal conversations, however many, are neighbours
    in the order and are spread over forests as all others are.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), ""))
    rows = found.select(F.coalesce(key, F.lit(b"")).alias("key"), "conv_id", F.transform("turns", lambda t: t["b"]).alias("sizes"))
    ordered, parts = in_order(rows, ["key", "conv_id"])
    nodes = cut(ordered.mapInArrow(forests(forest), NODE))
    discard(parts)
    closed, opened = nodes.where("not open"), nodes.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = opened.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_key").alias("parent_key"), *sums)
    ends = opened.where("ends != ''").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block").select("key", "ends")
    merged = cut(merged.join(ends.mapInArrow(_ends, "key binary, ends_sha256 string"), "key", "left"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.sha2(F.lit(b""), 256)
    joint = merged.join(parents, "parent_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    above = opened.select("block", F.col("node").alias("parent"), "key").join(merged.select("key", F.col("conv_id").alias("up")), "key").drop("key")
    inner = closed.where("parent_conv_id is not null or depth = 0")
    edge = closed.where("parent_conv_id is null and depth > 0").join(above, ["block", "parent"]).withColumn("parent_conv_id", F.col("up"))
    return inner.select(*RESULT).union(edge.select(*RESULT)).union(joint.select(*RESULT))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


QUERIES = {"op13_conversation_trie": op13_conversation_trie}

#: crc32 by bits over the id's digits, rebuilt conversations, then every beginning with its members.
_SQL = """
WITH ids AS (SELECT DISTINCT conv_id c FROM conversations WHERE conv_id IS NOT NULL),
codes AS (SELECT c, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) b FROM ids),
crc AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda s, x:
    list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, y: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) v FROM codes),
own AS (SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) i
    FROM conversations WHERE conv_id IS NOT NULL),
built AS (
    SELECT crc.c, own.i, r, x FROM crc JOIN own ON own.c = crc.c - crc.c % 5 AND own.i <= crc.v % 9
    UNION ALL SELECT crc.c, own.i, r, x FROM crc JOIN own ON own.c = crc.c AND own.i > crc.v % 9),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) d, md5(concat(strlen(r), ':', r, x)) h, strlen(x) n FROM built),
begun AS (
    SELECT c, d, string_agg(h, '') OVER (PARTITION BY c ORDER BY d) k, n FROM turns
    UNION ALL SELECT c, 0, '', 0 FROM ids),
stops AS (SELECT c, max(d) d FROM begun GROUP BY c),
nodes AS (SELECT k, d, min(c) c, count(*) m, (count(*) - 1) * min(n) own_saved FROM begun GROUP BY k, d),
ended AS (SELECT b.k, sha256(string_agg(CAST(b.c AS VARCHAR), ',' ORDER BY b.c)) e FROM begun b JOIN stops s ON s.c = b.c AND s.d = b.d GROUP BY b.k),
up AS (SELECT n.*, p.c pc, p.k pk FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = substr(n.k, 1, 32 * (n.d - 1))),
kids AS (SELECT pk k, count(*) n FROM up WHERE d > 0 GROUP BY pk),
below AS (SELECT substr(u.k, 1, CAST(32 * a.d AS INTEGER)) k, sum(u.own_saved) s, count(*) FILTER (WHERE kids.k IS NULL) l
    FROM up u LEFT JOIN kids USING (k) CROSS JOIN LATERAL (SELECT unnest(range(0, u.d + 1)) d) a GROUP BY 1)
SELECT u.c conv_id, u.d depth, u.pc parent_conv_id, u.m n_convs, coalesce(kids.n, 0) n_children, CAST(below.l AS BIGINT) n_leaves,
    CAST(below.s AS BIGINT) saved_tokens, coalesce(e, sha256('')) ends_sha256
FROM up u JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN ended USING (k)
"""
SQL = {"op13_conversation_trie": _SQL}
