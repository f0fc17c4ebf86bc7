"""Spelling variants against brute force: runs, near words with lists split at any size, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from harness import DATA
from pyspark.sql import functions as F

from sextant.llm import spelling
from sextant.llm._shared import table

LOWER = {i: i + 32 for i in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p:]


def counted(docs) -> dict[str, int]:
    total: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def grouped(words: dict[str, int]) -> set[tuple]:
    by_gap: dict[str, list[str]] = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_gap.setdefault(k, []).append(w)
    near = {w: {v for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by_gap[k] if one_edit(w, v)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else words[form[w]]) for w, n in words.items()}


def rows(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    out = spelling.op12_spelling_variants(spark, DATA)
    assert rows(out) == sorted(grouped(counted(docs)), key=str)
    assert [t for _, t in out.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]


@pytest.mark.parametrize(("limit", "letters", "longest"), [(2, "ab", 7), (5, "abé", 6), (40, "abcd", 5), (4096, "aàb", 6)])
def test_lists_of_any_size_give_the_same_words(spark, limit, letters, longest):
    pick = random.Random(limit)
    words = {"".join(pick.choice(letters) for _ in range(pick.randint(1, longest))): pick.randint(1, 400) for _ in range(250)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows(spelling.variants(df, limit)) == sorted(grouped(words), key=str)
    sizes = spelling.lists(df, limit).groupBy("short", "low", "high", "outer").agg(F.count("*").alias("c"), F.first(F.col("high") - F.col("low")).alias("w"))
    assert sizes.where(f"c > {limit} and w > 1").count() == 0


def test_scan_counts_every_pair_of_a_list_once():
    words = sorted({a + b + c for a in "xyz" for b in "xy" for c in "xyz"} | {"xx", "xy", "zz"})
    a, b = spelling.scan_lists(words, np.array([i == 0 for i in range(len(words))]), np.array([len(w) == 2 for w in words]), np.full(len(words), 9))
    assert sorted((words[i], words[j]) for i, j in zip(a, b, strict=True)) == sorted((x, y) for x in words for y in words if len(x) == 2 and one_edit(x, y) and (len(y) == 3 or x < y))


def test_chains_and_ties(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "ccccc": 5, "ccccd": 10, "cccce": 10, "fffff": 7, "ffffg": 13, "zzzzz": 4}
    out = {r[0]: r for r in rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert out["aaaaa"][1:3] == ("aaaab", "abbbb") and out["ccccc"][1] == "ccccd" and out["fffff"][1:] == (None, "fffff", 7, 1, None) and out["zzzzz"][4] == 0
    assert set(out.values()) == grouped(words)


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(spelling.variants(spelling.vocabulary(spelling.runs(odd)))) == sorted(grouped(counted(docs)), key=str)
    long = spark.createDataFrame([(i, "q" * 3000 + "w" * (i % 2)) for i in range(8)], "doc_id long, text string")
    words = counted([tuple(r) for r in long.collect()])
    assert words and rows(spelling.variants(spelling.vocabulary(spelling.runs(long)))) == sorted(grouped(words), key=str)
    assert spelling.variants(spelling.vocabulary(spelling.runs(empty))).count() == 0
