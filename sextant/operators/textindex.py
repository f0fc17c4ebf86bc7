"""Index tables over text and XML columns, and the searches that join them."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import scalars


def keywords(rows: DataFrame, key: str, columns: Sequence[str], stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, col, word): the distinct tokens of each text column."""
    listed = F.array(*[F.struct(F.lit(c).alias("col"), scalars.tokens(F.col(c), stop_words).alias("words")) for c in columns])
    cells = rows.select(key, F.explode(listed).alias("cell"))
    return cells.select(key, "cell.col", F.explode("cell.words").alias("word"))


def stems(index: DataFrame, stem: Callable[[str], str], key: str = "id") -> DataFrame:
    """(key, col, stem) from a keyword index: each distinct word is stemmed once, then joined back."""
    vocabulary = index.select("word").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([stem(w) for w in words], pa.string())], names=["word", "stem"])

    return index.join(vocabulary.mapInArrow(run, "word string, stem string"), "word").select(key, "col", "stem").distinct()


#: Endings of the plain English stemmer below, longest first within a step.
_STEPS = (
    (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")),
    (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("ation", "ate"), ("alism", "al"), ("entli", "ent"), ("ousli", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("ator", "ate"), ("izer", "ize"), ("alli", "al"), ("eli", "e"), ("bli", "ble"), ("logi", "log")),
    (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")),
    (("ement", ""), ("ance", ""), ("ence", ""), ("able", ""), ("ible", ""), ("ment", ""), ("ant", ""), ("ent", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""), ("al", ""), ("er", ""), ("ic", ""), ("ou", "")),
)


def _measure(word: str) -> tuple[int, bool]:
    """Vowel-consonant turns of a word, and whether it has a vowel."""
    turns, before, any_ = 0, False, False
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and not before)
        turns += before and not vowel
        before = vowel
        any_ = any_ or vowel
    return turns, any_


def suffix_stem(word: str) -> str:
    """The stem of a lower-case word by Porter's suffix rules (Porter, 1980)."""
    if len(word) < 3:
        return word
    for a, b in _STEPS[0]:
        if word.endswith(a):
            word = word[: len(word) - len(a)] + b
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3])[0] > 0 else word
    else:
        for a in ("ed", "ing"):
            if word.endswith(a) and _measure(word[: -len(a)])[1]:
                word = word[: -len(a)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                    word = word[:-1]
                elif _measure(word)[0] == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _measure(word[:-1])[1]:
        word = word[:-1] + "i"
    for step, least in ((1, 0), (2, 0), (3, 1)):
        for a, b in _STEPS[step]:
            if word.endswith(a):
                if _measure(word[: -len(a)])[0] > least:
                    word = word[: -len(a)] + b
                break
        else:
            if step == 3 and word.endswith("ion") and word[-4:-3] in ("s", "t") and _measure(word[:-3])[0] > 1:
                word = word[:-3]
    if word.endswith("e"):
        m = _measure(word[:-1])[0]
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1])[0] > 1 else word


def _short(word: str) -> bool:
    """Whether a word ends consonant, vowel, consonant other than w, x, y."""
    if len(word) < 3:
        return False
    v = [c in "aeiou" or (c == "y" and i > 0 and word[i - 1] not in "aeiou") for i, c in enumerate(word)]
    return not v[-3] and v[-2] and not v[-1] and word[-1] not in "wxy"


def alarms(rows: DataFrame, key: str, columns: Sequence[str], alarm_words: Sequence[str]) -> DataFrame:
    """(key, word1, word2, field, distance) where exactly two alarm words stand in a text, each between spaces."""
    upper = sorted({scalars.upper_text(w) for w in alarm_words})
    listed = F.array(*[F.struct(F.lit(c).alias("field"), scalars.upper(F.col(c)).alias("text")) for c in columns])
    cells = rows.select(key, F.explode(listed).alias("cell")).select(key, "cell.field", "cell.text")
    places = F.filter(F.array(*[F.struct(F.locate(f" {w} ", F.col("text")).alias("at"), F.lit(w).alias("word")) for w in upper]), lambda s: s["at"] > 0)
    found = cells.select(key, "field", F.array_sort(places).alias("s")).where(F.size("s") == 2)
    one, two = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    distance = two["at"] - one["at"] - F.length(one["word"])
    pair = [one["word"], two["word"]]
    return found.select(key, F.least(*pair).alias("word1"), F.greatest(*pair).alias("word2"), "field", distance.alias("distance"))


def near(rows: DataFrame, index: DataFrame, key: str, field: str, first: str, second: str, condition: Callable[[Column], Column]) -> DataFrame:
    """Rows whose two alarm words stand at a distance that meets ``condition``, nearest first."""
    return rows.join(near_keys(index, key, field, first, second, condition), key).orderBy("distance", key)


def near_keys(index: DataFrame, key: str, field: str, first: str, second: str, condition: Callable[[Column], Column]) -> DataFrame:
    """(key, distance) of the same rows, from the index alone: one for each indexed text, also where keys repeat or are null."""
    low, high = sorted([scalars.upper_text(first), scalars.upper_text(second)])
    hit = index.where((F.col("field") == field) & (F.col("word1") == low) & (F.col("word2") == high) & condition(F.col("distance")))
    return hit.select(key, "distance")


def search(rows: DataFrame, index: DataFrame, key: str, column: str, word: str, name: str = "word") -> DataFrame:
    """Rows with a word (or stem, by ``name``) in a column; a semi-join, so no row comes twice."""
    return rows.join(index.where((F.col("col") == column) & (F.col(name) == word)), key, "left_semi")


def xml_paths(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field, path, rootless, tag, value): text nodes below the root. Text that is no XML gives none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                stack = [(root, f"/{root.tag}", "")]
                while stack:
                    node, path, short = stack.pop()
                    for child in node:
                        stack.append((child, f"{path}/{child.tag}", f"{short}/{child.tag}"))
                    if node is not root and (node.text or "").strip():
                        for c, v in zip(out, (k, path, short, node.tag, node.text.strip()), strict=True):
                            c.append(v)
            types = [batch.schema.field(0).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["id", "path", "rootless", "tag", "value"])

    found = rows.select(key, column).mapInArrow(run, f"id {kind}, path string, rootless string, tag string, value string")
    return found.select(F.col("id").alias(key), F.lit(column).alias("field"), "path", "rootless", "tag", "value")


def xml_leaf(rows: DataFrame, index: DataFrame, key: str, tag: str, value: str) -> DataFrame:
    return rows.join(index.where((F.col("tag") == tag) & (F.upper("value") == value.upper())), key, "left_semi")


def xml_path(rows: DataFrame, index: DataFrame, key: str, path: str, value: str) -> DataFrame:
    return rows.join(index.where((F.col("path") == path) & (F.upper("value") == value.upper())), key, "left_semi")


def row_hashes(rows: DataFrame, key: str, columns: Sequence[Column]) -> DataFrame:
    return rows.select(key, scalars.row_hash(*columns).alias("hash"))
