"""The conversation trie against its SQL and against brute force over small forests."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from harness import DATA, difference
from pyspark.sql import functions as F

from sextant.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, block string"


def brute(rows, rebuild=True):
    """Nodes of the trie, every beginning written out."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), r, digest, x))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:] if rebuild else turns
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        children = [n for n in members if len(n) == d + 1 and n[:d] == node]
        below = [n for n in members if n[:d] == node]
        leaves = sum(1 for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below))
        saved = sum((len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == d)))
        out.append((min(convs), d, min(members[node[:-1]]) if d else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed, convs=60):
    pick = random.Random(seed)
    out = []
    for c in range(convs):
        for turn in range(pick.choice([0, 1, 1, 2, 3, 3, 4, 7])):
            out.append((c, turn, pick.choice(["user", "user", None, "assistant"]), pick.choice(["a", "a", "é", "", None, "bcd"])))
    return out


def got(df):
    return sorted((tuple(r) for r in df.select(*trie.RESULT).collect()), key=str)


def test_query_equals_its_sql(spark):
    assert not difference(spark, "op13", trie.op13_conversation_trie, trie._SQL, DATA)


@pytest.mark.parametrize(("seed", "size"), [(1, 1), (2, 2), (3, 5), (4, 1000)])
def test_forests_of_any_size_give_the_same_nodes(spark, seed, size):
    made = rows(seed)
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in made], SCHEMA).repartition(3)
    assert got(trie.prefix_trie(trie.rebuilt(trie.sequences(df)), size)) == brute(made)
    assert got(trie.prefix_trie(trie.sequences(df), size)) == brute(made, False)


def test_conversations_that_are_all_alike(spark):
    made = [(c, t, "user", f"turn {t}") for c in range(40) for t in range(3)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    nodes = got(trie.prefix_trie(trie.sequences(df), 3))
    assert nodes == brute(made, False) and len(nodes) == 4


def test_odd_rows(spark):
    made = [(1, None, None, None), (1, None, None, None), (1, 2, "user", "x" * 200_000), (None, 0, "user", "lost"), (7, 1, "user", ""), (7, 1, "user", ""), (8, 5, "", None), (-3, 1, "user", "below zero")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    assert got(trie.prefix_trie(trie.rebuilt(trie.sequences(df)))) == brute(made)
    long = [(3, t, "user", "same") for t in range(700)] + [(4, t, "user", "same") for t in range(650)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    nodes = got(trie.prefix_trie(trie.sequences(df), 1))
    assert len(nodes) == 701 and max(n[1] for n in nodes) == 700 and sum(n[5] for n in nodes if n[1] == 0) == 1


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = trie.prefix_trie(trie.rebuilt(trie.sequences(empty)))
    assert out.columns == list(trie.RESULT) and out.count() == 0
    assert dict(out.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in trie.RESULT}


def test_rebuilt_conversations_may_be_left_without_turns(spark):
    found = trie.sequences(spark.createDataFrame([(c, 0, "user", "only") for c in range(1, 5)], "conv_id long, turn long, role string, text string"))
    sizes = {r.conv_id: r.n for r in trie.rebuilt(found).select("conv_id", F.size("turns").alias("n")).collect()}
    assert sizes == {c: int(zlib.crc32(str(c).encode()) % 9 == 0) for c in range(1, 5)}
