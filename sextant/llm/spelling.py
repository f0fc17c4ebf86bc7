"""Spelling variants: words one edit apart, each grouped under its most frequent neighbours' root."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import col, cut, discard, table

LETTERS = "a-z\\u00C0-\\u00FF"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words count from so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a code point, by checksum.
SLIP = 97
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 2
#: Words in a list that is scanned; beyond it the list is split where words differ.
LIST = 4096
#: Words in lists that are scanned in step.
STEP_WORDS = 32_768


def runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): one row for each run of letters with at least ``LEAST_LENGTH`` letters left, A-Z lower-cased.

    A run whose checksum with its document is a multiple of ``SLIP`` loses the
    letter that the checksum points at. Null texts have no runs; a null id
    counts as the empty string.
    """
    found = F.explode(F.regexp_extract_all(F.translate(col(text), CAPITALS, SMALL), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0)))
    words = df.select(F.coalesce(col(doc_id).cast("string"), F.lit("")).alias("doc"), found.alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    return words.select("run", h.alias("h")).select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) of the words with at least ``LEAST_COUNT`` rows."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


# -- lists that near words share ------------------------------------------------------------------------


def _windows(low: Column, high: Column) -> Column:
    """Two halves of the places low..high - 1."""
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def _keyed(rows: DataFrame) -> DataFrame:
    """(short, low, high, outer, word, n): ``outer`` is the word without the places of its window.

    ``short`` is the length of the shorter word of a pair; a word with one more
    letter has one more place in the window.
    """
    longer = F.length("word") - F.col("short")
    rest = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("\x00"), F.substring("word", F.col("high") + longer + 1, F.length("word")))
    return rows.select("short", "low", "high", rest.alias("outer"), "word", "n")


def lists(words: DataFrame, limit: int = LIST) -> DataFrame:
    """Rows (short, low, high, outer, word, n) such that words one edit apart share exactly one
    (short, low, high, outer) whose places low..high - 1 hold their first difference.

    Each word stands in both halves of its own length and of one letter less.
    A list of more than ``limit`` words is split again into the halves of its
    places, and so on, so no list grows with the vocabulary: with one place
    left, its words differ in two letters at most.
    """
    key = ["short", "low", "high", "outer"]
    length = F.length("word")
    starts = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short")).where("short > 0")
    halves = lambda rows: rows.select("word", "n", "short", F.explode(_windows(F.col("low"), F.col("high"))).alias("w"))
    opened = lambda rows: _keyed(rows.select("word", "n", "short", "w.low", "w.high").where("low < high"))
    level = cut(opened(halves(starts.withColumn("low", F.lit(0)).withColumn("high", F.col("short") + 1))))
    done = None
    while True:
        hot = level.groupBy(*key).count().where((F.col("count") > limit) & (F.col("high") - F.col("low") > 1)).select(*key)
        hot = cut(hot)
        if hot.isEmpty():
            discard(hot)
            return level if done is None else done.unionByName(level)
        small = level.join(hot, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        level = cut(opened(halves(level.join(hot, key, "left_semi"))))


# -- scanning a sorted list -----------------------------------------------------------------------------


def _transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next band row for each row and each of eight outcomes of comparing three letters, whether a row is
    dead, and its three cells. A row holds distances 0, 1 or 2 and more to one letter less, as many and one more."""
    cells = np.array([(a, b, c) for a in range(3) for b in range(3) for c in range(3)], np.uint8)
    code = lambda a, b, c: 9 * a + 3 * b + c
    step = np.zeros((27, 8), np.uint8)
    for s, (left, same, right) in enumerate(cells.tolist()):
        for bits in range(8):
            differs = bits >> 2 & 1, bits >> 1 & 1, bits & 1
            a = min(left + differs[0], same + 1, 2)
            b = min(same + differs[1], right + 1, a + 1, 2)
            c = min(right + differs[2], b + 1, 2)
            step[s, bits] = code(a, b, c)
    return step.ravel(), cells.min(axis=1) >= 2, cells


STEP, DEAD, CELLS = _transitions()
#: The row before any letter: nothing to the left, no distance, one letter to insert.
START = 9 * 2 + 3 * 0 + 1


def _neighbours(flat: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Letters that each word shares with the one before it; -1 at the start of a list."""
    lengths = np.diff(offsets)
    shared = np.where(first, -1, 0)
    live = np.flatnonzero(~first)
    depth = 0
    while len(live):
        live = live[(lengths[live] > depth) & (lengths[live - 1] > depth)]
        live = live[flat[offsets[live] + depth] == flat[offsets[live - 1] + depth]]
        depth += 1
        shared[live] = depth
    return shared


def scan_lists(middles: list[str], first: np.ndarray, short: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart within sorted lists, a row of the shorter length first.

    ``first`` marks the first row of a list, ``short`` the rows of the shorter
    length, ``width`` the places in which the first difference must lie. Each
    short row is a query: a cursor walks its list from the start, one letter a
    step, and extends the banded row of the edit matrix of the prefix read so
    far. The next word starts from the row at the letters that it shares with
    the last one; a dead row skips all words that share its prefix. All queries
    step together in arrays.
    """
    n = len(middles)
    flat = np.frombuffer("".join(middles).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
    lengths = np.fromiter(map(len, middles), np.int64, n)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    lcp = _neighbours(flat, offsets, first)
    starts = np.flatnonzero(first)
    begin = starts[np.cumsum(first) - 1]
    end = np.append(starts[1:], n)[np.cumsum(first) - 1]
    #: The next row whose shared letters are fewer than this one's.
    fewer, stack = np.full(n, n, np.int64), []
    for i, v in enumerate(lcp.tolist()):
        while stack and lcp[stack[-1]] > v:
            fewer[stack.pop()] = i
        stack.append(i)
    query = np.flatnonzero(short & (end - begin > 1))
    room = lengths[query] + 3
    base = np.cumsum(room) - room
    rows = np.full(int(room.sum()), START, np.uint8)
    at, depth, own = begin[query], np.zeros(len(query), np.int64), query
    left, right = [], []
    while len(own):
        length_q, length_w = lengths[own], lengths[at]
        blank = length_w == 0
        # one letter further in the word under the cursor
        letter = flat[offsets[at] + depth]
        q = offsets[own]
        bits = np.zeros(len(own), np.int64)
        for k, shift in ((-1, 2), (0, 1), (1, 0)):
            place = depth + k
            inside = (place >= 0) & (place < length_q)
            bits |= ~(inside & (flat[q + np.where(inside, place, 0)] == letter)) << shift & (1 << shift)
        row = STEP[rows[base + depth] * np.int64(8) + bits]
        row = np.where(blank, START, row)
        rows[base + np.where(blank, 0, depth + 1)] = row
        reached = np.where(blank, 0, depth + 1)
        whole = reached == length_w
        dead = DEAD[row]
        gap = length_q - length_w  # 0 or -1
        value = CELLS[row, np.clip(gap + 1, 0, 2)]
        hit = whole & (value == 1) & ((gap == -1) | ((gap == 0) & (at > own)))
        if hit.any():
            left.append(own[hit])
            right.append(at[hit])
        # where to go on
        jump = whole | dead
        following = at + 1
        if jump.any():
            bound = np.where(dead, reached, np.iinfo(np.int64).max)
            stop = end[own]
            while True:  # over the words that share a dead prefix
                far = jump & (following < stop) & (lcp[np.minimum(following, n - 1)] >= bound)
                if not far.any():
                    break
                following = np.where(far, fewer[np.minimum(following, n - 1)], following)
            on = ~jump | (following < stop)
            at = np.where(jump, following, at)
            depth = np.where(jump, lcp[np.minimum(following, n - 1)], reached)
            own, at, depth, base = own[on], at[on], depth[on], base[on]
        else:
            depth = reached
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    keep = _first_difference(flat, offsets, a, b) < width[a]
    return a[keep], b[keep]


def _first_difference(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lengths = np.diff(offsets)
    out = np.zeros(len(a), np.int64)
    live, depth = np.arange(len(a)), 0
    while len(live):
        x, y = a[live], b[live]
        live = live[(lengths[x] > depth) & (lengths[y] > depth)]
        live = live[flat[offsets[a[live]] + depth] == flat[offsets[b[live]] + depth]]
        depth += 1
        out[live] = depth
    return out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (word, near, n_near), both ways, of lists that come sorted, a bounded number of whole lists at a time."""
    held: list[tuple] = []

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        keys = [r[:4] for r in rows]
        first = np.fromiter((i == 0 or keys[i] != keys[i - 1] for i in range(len(rows))), bool, len(rows))
        middles = [r[4][r[1] : r[2] + len(r[4]) - r[0]] for r in rows]
        short = np.fromiter((len(r[4]) == r[0] for r in rows), bool, len(rows))
        a, b = scan_lists(middles, first, short, np.fromiter((r[2] - r[1] for r in rows), np.int64, len(rows)))
        x, y = np.concatenate([a, b]).tolist(), np.concatenate([b, a]).tolist()
        return pa.RecordBatch.from_pydict({"word": pa.array([rows[i][4] for i in x], pa.string()), "near": pa.array([rows[i][4] for i in y], pa.string()), "n_near": pa.array([rows[i][5] for i in y], pa.int64())})

    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        held += rows
        if len(held) >= STEP_WORDS:
            last = held[-1][:4]
            whole = len(held)
            while whole and held[whole - 1][:4] == last:
                whole -= 1
            if whole:
                yield pairs(held[:whole])
                held = held[whole:]
    if held:
        yield pairs(held)


def near_words(words: DataFrame, limit: int = LIST) -> DataFrame:
    """(word, near, n_near): all pairs of ``words`` (word, n, words distinct) that one inserted, deleted or
    replaced code point separates, each pair both ways."""
    listed = lists(words, limit)
    key = ["short", "low", "high", "outer"]
    middle = F.substring("word", F.col("low") + 1, F.col("high") - F.col("low") + F.length("word") - F.col("short"))
    ordered = listed.withColumn("middle", middle).repartition(*key).sortWithinPartitions(*key, "middle").select(*key, "word", "n")
    return ordered.mapInArrow(_scanned, "word string, near string, n_near long")


def variants(words: DataFrame, limit: int = LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n), words distinct.

    ``form`` is the near word of largest n, the smallest in code-point order
    among equals, where that n is at least ``FORM_RATIO`` times the word's; null
    otherwise. ``root`` is where the forms lead. Along forms n doubles at least,
    so chains are short; pointers are doubled until none has a form left.
    """
    words = cut(words)
    best = near_words(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("n"), F.col("near").alias("w"))).alias("b"))
    joined = words.join(best.select("word", "n_near", F.col("b.w").alias("near"), (-F.col("b.n")).alias("near_n")), "word", "left")
    good = F.col("near_n") >= FORM_RATIO * F.col("n")
    found = cut(joined.select(
        "word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near_n")).alias("form_n")
    ))
    to = found.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        onward = to.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = cut(to.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            roots = moved.select("word", F.col("to").alias("root"))
            return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        to = moved.select("word", "to")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(runs(table(spark, sf_dir, "documents"))))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
#: Every run's checksum over whole texts is too slow in SQL; the tests compare with brute force.
SQL: dict[str, str] = {}
