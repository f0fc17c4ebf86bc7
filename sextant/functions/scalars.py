"""Scalar functions over Columns: text, lists, dates, hashes, coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean null, true and false in result files.
NULLS = ("NULL", "None", "")
TRUES = ("true", "True", "TRUE", "1", "t", "T", "yes", "Yes")
FALSES = ("false", "False", "FALSE", "0", "f", "F", "no", "No")
#: Bytes of storage types, by name.
WIDTHS = {"TINYINT": 1, "SMALLINT": 2, "INT": 4, "BIGINT": 8, "DATE": 3, "ENUM": 2}
#: Letters that ``F.upper`` writes as several characters, and the one that each is in upper case by itself.
WIDE = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def upper(text: Column) -> Column:
    """Upper case of each character by itself, so that places and lengths stay: ``ß`` becomes ``ẞ``, ``ﬁ`` stays."""
    text = F.replace(text, F.lit("ß"), F.lit("ẞ"))
    wide = "".join(c for c in WIDE if c != "ß")
    parts = F.split(text, f"(?<=[{wide}])|(?=[{wide}])")
    each = F.transform(parts, lambda p: F.when(p.rlike(f"[{wide}]"), F.translate(p, wide, "".join(WIDE[c] for c in wide))).otherwise(F.upper(p)))
    # only a text with such a letter grows
    return F.when(F.length(F.upper(text)) > F.length(text), F.array_join(each, "")).otherwise(F.upper(text))


def upper_text(text: str) -> str:
    """The same for a value of the driver's."""
    return "".join(WIDE.get(c) or c.upper() for c in text)


def lower(text: Column) -> Column:
    """Lower case of each character by itself: a sigma is the same at a word's end, a dotted capital i is one letter."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Distinct lower-case tokens, split at spaces and ``. , ! ? - ; "``, without stop words."""
    found = F.array_distinct(F.filter(F.split(lower(text), r'[ .,!?;"-]+'), lambda w: w != ""))
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else found


def proximity(text: Column, first: str, second: str) -> Column:
    """Characters between two words, each standing between spaces; null unless both do.

    The distance of their beginnings less the length of the earlier word.
    """
    padded = upper(text)
    a, b = F.locate(f" {upper_text(first)} ", padded), F.locate(f" {upper_text(second)} ", padded)
    gap = F.when(a < b, b - a - len(first)).otherwise(a - b - len(second))
    return F.when((a > 0) & (b > 0), gap)


def label(code: Column, labels: dict[int, str]) -> Column:
    """The upper-case label of a code, by a literal map (a few hundred entries at most)."""
    pairs = [F.lit(x) for k, v in labels.items() for x in (k, v.upper())]
    return F.element_at(F.create_map(*pairs), code)


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def row_width(schema: DataFrame, kind: str = "type", length: str = "length") -> Column:
    """Sum of the byte widths of a schema frame's columns."""
    base = F.regexp_extract(F.upper(F.col(kind)), r"^([A-Z]+)", 1)
    by_length = F.coalesce(F.regexp_extract(F.col(kind), r"\((\d+)\)", 1).try_cast("int"), F.col(length).cast("int"), F.lit(0))
    width = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in WIDTHS.items() for x in p]), base), by_length)
    return F.sum(width)


def epoch(day: Column, time: Column, fmt: str = "yyyyMMdd HH:mm:ss") -> Column:
    return F.unix_timestamp(F.concat_ws(" ", day, time), fmt)


def epoch_text(seconds: Column) -> Column:
    """Seconds since the epoch as text to the microsecond."""
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("long")), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def micros(time: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    time = F.col(time) if isinstance(time, str) else time
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def latency(first: Column, second: Column) -> Column:
    return second - first


def in_band(x: Column, low: float | None, high: float | None, low_open: bool = False, high_open: bool = True) -> Column:
    """Between two bounds, each open or closed; None is no bound."""
    out = F.lit(True)
    if low is not None:
        out = out & (x > low if low_open else x >= low)
    if high is not None:
        out = out & (x < high if high_open else x <= high)
    return out


def birth_date(age: Column, days: Column, year: int = 2013) -> Column:
    """1 January of ``year`` - age, less 0 to 365 days."""
    return F.date_sub(F.make_date(F.lit(year) - age, F.lit(1), F.lit(1)), days)


def last_update(born: Column, uniform: Column) -> Column:
    """A second between the later of 1970 and birth, and 2014."""
    low = F.greatest(F.lit(0), F.unix_timestamp(born.cast("timestamp")))
    high = F.lit(1388534400)
    return (low + F.floor(uniform * (high - low))).cast("long")


def from_pipes(text: Column) -> Column:
    """The elements of a list in pipe text; empty ones are left out."""
    return F.filter(F.split(text, r"\|"), lambda x: x != "")


def to_pipes(items: Column) -> Column:
    return F.array_join(items, "|")


def normal_null(text: Column) -> Column:
    return F.when(text.isin(*NULLS), None).otherwise(text)


def normal_bool(text: Column) -> Column:
    """False for the false texts, null for the null texts, true for the rest."""
    return F.when(text.isNull() | text.isin(*NULLS), None).when(text.isin(*FALSES), False).otherwise(True)


def multi_values(field: Column) -> Column:
    """``[a,b]`` as an array; any other text as an array of itself."""
    inner = F.regexp_extract(field, r"^\[(.*)\]$", 1)
    return F.when(field.rlike(r"^\[.*\]$"), F.split(inner, ",")).otherwise(F.array(field))


def expand(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each combination of the values of multi-valued fields."""
    for f in fields:
        rows = rows.withColumn(f, F.explode(multi_values(F.col(f))))
    return rows


def row_hash(*values: Column) -> Column:
    """MD5 of the concatenated values, which the caller has put into text form; a null adds nothing."""
    return F.md5(F.concat(*[F.coalesce(v.cast("string"), F.lit("")) for v in values]))


def uniform(seed: int, name: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) that depends on the seed, the variable and the row's keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def shown(x: Column, digits: int = 3) -> Column:
    """A number as a report shows it; N/A for null."""
    return F.when(x.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))
