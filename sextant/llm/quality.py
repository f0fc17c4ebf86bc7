"""Quality rules, lines first.

Each line with a word is held against rules on punctuation, navigation and
boilerplate. Lines that fail are removed; a document that loses too much of
its text with them is rejected, and so is one that fails the base rules.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import col, fresh, scan, table

#: Base rules: fewest words, and the largest percentage of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: The largest percentage of a document's word characters that may be in removed lines.
MAX_REMOVED = 50
#: A line of fewer words has to end in a punctuation mark.
FRAGMENT_WORDS = 5
#: Boilerplate phrases count in lines of at most this many words.
BOILERPLATE_WORDS = 30
SYMBOLS = "#*$%&|<>"
LAST = ".!?…:;,\"')]}»”’。！？"
PHRASES = (
    "all rights reserved", "licensed under", "under the mit license", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use of cookies", "enable javascript", "click here", "read more",
    "sign in", "log in", "subscribe to", "share this", "back to top", "skip to content",
)
_BOILERPLATE = re.compile("|".join(PHRASES).encode())
_CAPITALS, _SMALL = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")
_SPACE = " \t\n\x0b\x0c\r"

FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("n_lines", T.LongType()), ("n_bad_lines", T.LongType()), ("removed_chars", T.LongType()), ("clean_text", T.StringType()),
]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in often:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def bad_line(line: str, words: list[bytes]) -> bool:
    """Whether a line with words fails a rule."""
    n = len(words)
    symbols = sum(map(line.count, SYMBOLS))
    if symbols > 2 and symbols * 5 > n:  # symbols in place of punctuation
        return True
    if line.count("|") + line.count("›") + line.count("»") >= 3 and symbols * 10 > n:  # rows of links and cells
        return True
    marks = line.count("!") + line.count("?")
    if marks > 3 and marks * 3 > n:  # runs of marks
        return True
    if n < FRAGMENT_WORDS and line.rstrip(_SPACE)[-1] not in LAST:  # headings and menu entries
        return True
    if n > 2:
        capitals = len(_CAPITALS.findall(line))
        if capitals > 10 and capitals > len(_SMALL.findall(line)):  # shouting
            return True
    return n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line.encode().lower()) is not None


def judge(text: str | None) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # splits at 20 and 09-0D only, as bytes do
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    seen, kept, lines, bad, removed, dup = set(), [], 0, 0, 0, 0
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            kept.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if bad_line(line, own):
            bad += 1
            removed += len(line) - sum(map(line.count, _SPACE))
        else:
            kept.append(line)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    good = not failed and 100 * removed <= MAX_REMOVED * chars
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, failed, good, lines, bad, removed, "\n".join(kept)


def assess(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, both verdicts and the cleaned text of every row.

    One scan without a shuffle. A null text counts as empty: no words, so it
    fails the base rules. Lines without a word are neither counted nor removed.
    Repeated rows get equal values; other columns are not read. A field whose
    name is among ``keep`` gets underscores behind it.
    """

    def make():
        return lambda texts: list(zip(*map(judge, texts), strict=True)) if texts else [[] for _ in FIELDS]

    return scan(docs, text, keep, [(fresh(n, keep), kind) for n, kind in FIELDS], make)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, with what the line rules removed."""
    return assess(table(spark, sf_dir, "documents")).drop("clean_text")


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents without their failed lines; ``n_chars`` follows the text."""
    keep = tuple(c for c in docs.columns if c != "text")
    kept, clean = fresh("kept", keep), fresh("clean_text", keep)
    out = assess(docs, keep=keep).where(col(kept))
    return out.select(*[col(clean).alias(c) if c == "text" else F.length(col(clean)).cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns])


_MARK = "[" + "".join("\\" + c if c in "]\"')}" else c for c in LAST).replace("'", "''") + "]"
QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g3 WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
  length(line) - length(regexp_replace(line, '[|›»]', '', 'g')) AS bars,
  length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS marks,
  length(line) - length(regexp_replace(line, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS capitals,
  length(line) - length(regexp_replace(line, '[a-zß-öø-ÿ]', '', 'g')) AS small
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lb AS (SELECT *, (symbols > 2 AND symbols * 5 > n) OR (bars >= 3 AND symbols * 10 > n) OR (marks > 3 AND marks * 3 > n)
  OR (n < {FRAGMENT_WORDS} AND NOT regexp_matches(line, '{_MARK}[\x20\x09-\x0D]*$'))
  OR (n > 2 AND capitals > 10 AND capitals > small)
  OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '(?i){"|".join(PHRASES)}')) AS bad FROM lw),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE bad) AS bad_lines,
  coalesce(sum(chars) FILTER (WHERE bad), 0) AS removed FROM lb GROUP BY doc_id),
j AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(bad_lines, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(removed, 0) AS BIGINT) AS removed_chars
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN ls ON w.doc_id = ls.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * removed_chars <= {MAX_REMOVED} * word_chars AS kept,
  n_lines, n_bad_lines, removed_chars FROM j"""
}
