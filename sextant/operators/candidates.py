"""Candidate queries with WHERE texts whose results have a wanted size, looked up in counts of the values.

No candidate is tried on the table: each generator counts, once, everything it
could ask for, and keeps what lies in the band. Counts are those of upper-case
text, as all text comparisons of the library are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import cumulative, word_counts

#: Candidates for each wanted query.
OVER = 2
#: A blank in the middle leaves so many characters on both sides.
MARGIN = 4


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def _literal(text: Column) -> Column:
    """``text`` within a LIKE pattern."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def pick(candidates: DataFrame, n: int, seed: int, by: Sequence[str] = ("category", "sub_category", "field")) -> DataFrame:
    """``OVER`` x n candidates of each kind, each WHERE text once, in an order that the seed and the text fix."""
    once = candidates.dropDuplicates(["where"])
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), "where"), "where")
    return once.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= OVER * n).drop("_place")


# -- patterns -----------------------------------------------------------------------------------------------


def masked(rows: DataFrame, field: str, lengths: Sequence[int]) -> DataFrame:
    """(sub_category, keyword_len, pattern, n): every pattern that a value could be asked by, with the rows that match it.

    One character blank: ``initial-one``, ``final-one`` and, at every place with
    MARGIN characters on both sides, ``middle-one``. More: ``final`` is a
    beginning, ``initial`` an ending and ``both`` any part of ``lengths``
    characters. Distinct values are counted first and masked once each.
    """
    values = rows.where(F.col(field).isNotNull()).groupBy(F.upper(F.col(field).cast("string")).alias("v")).agg(F.count("*").alias("n"))
    v, size = F.col("v"), F.length("v")
    form = lambda kind, length, pattern: F.struct(F.lit(kind).alias("sub_category"), F.lit(length).cast("int").alias("keyword_len"), pattern.alias("pattern"))
    part = lambda start, length: _literal(F.substring(v, start, length))
    one = lambda c: F.array(c)
    none = lambda c: F.filter(one(c), lambda _: F.lit(False))
    only = lambda test, made, sample: F.when(test, made).otherwise(none(sample))
    blank = form("final-one", None, F.concat(part(F.lit(1), size - 1), F.lit("_")))
    middle = F.transform(F.sequence(F.lit(MARGIN + 1), F.greatest(size - MARGIN, F.lit(MARGIN + 1))), lambda i: form("middle-one", None, F.concat(part(F.lit(1), i - 1), F.lit("_"), part(i + 1, size))))
    within = lambda k: lambda i: form("both", k, F.concat(F.lit("%"), part(i, F.lit(k)), F.lit("%")))
    forms = [only(size >= 2, one(blank), blank), only(size >= 2, one(form("initial-one", None, F.concat(F.lit("_"), part(F.lit(2), size)))), blank), only(size > 2 * MARGIN, middle, blank)]
    for k in lengths:
        places = F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1)))
        inner = F.array_distinct(F.transform(places, within(k)))
        ends = F.array(form("final", k, F.concat(part(F.lit(1), F.lit(k)), F.lit("%"))), form("initial", k, F.concat(F.lit("%"), part(size - k + 1, F.lit(k)))))
        forms.append(only(size >= k, F.concat(inner, ends), blank))
    return values.select("n", F.explode(F.concat(*forms)).alias("f")).groupBy("f.sub_category", "f.keyword_len", "f.pattern").agg(F.sum("n").alias("n"))


def wildcard_candidates(rows: DataFrame, field: str, lengths: Sequence[int], low: int, high: int) -> DataFrame:
    """(category, sub_category, field, keyword_len, search_for, where, n) of the patterns that ``low`` to ``high`` rows match."""
    found = masked(rows, field, lengths).where(F.col("n").between(low, high))
    text = F.concat(F.lit(f"upper({field}) LIKE "), quoted(F.col("pattern")), F.when(F.contains("pattern", F.lit("\\")), F.lit(" ESCAPE '\\'")).otherwise(F.lit("")))
    category = F.when(F.col("sub_category").endswith("-one"), "P6").otherwise("P7")
    return found.select(category.alias("category"), "sub_category", F.lit(field).alias("field"), "keyword_len", F.col("pattern").alias("search_for"), text.alias("where"), "n")


def keyword_candidates(rows: DataFrame, key: str, field: str, length: int, low: int, high: int) -> DataFrame:
    """Words of ``length`` characters that ``low`` to ``high`` rows contain."""
    found = word_counts(rows, key, field).where((F.length("word") == length) & F.col("n_rows").between(low, high))
    text = F.concat(F.lit(f"CONTAINED_IN({field}, "), quoted(F.col("word")), F.lit(")"))
    return found.select(F.lit("P3").alias("category"), F.lit("word").alias("sub_category"), F.lit(field).alias("field"), F.lit(length).alias("keyword_len"), F.col("word").alias("search_for"), text.alias("where"), F.col("n_rows").alias("n"))


# -- XML ----------------------------------------------------------------------------------------------------


def path_summary(index: DataFrame, key: str = "id") -> DataFrame:
    """(path, parent, depth, n_rows, n_values): the tree of all paths in the documents, inner nodes included.

    ``index``: rows (key, path, value) of an XML path index. A row counts once
    for a path, however often it has it; inner nodes have no values.
    """
    steps = F.split(F.col("path"), "/")
    ups = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    leaves = index.select(key, "path", "value").distinct()
    nodes = leaves.select(key, F.explode(ups).alias("node"), (F.col("path")).alias("leaf"), "value")
    per_row = nodes.select(key, "node").distinct().groupBy("node").agg(F.count("*").alias("n_rows"))
    values = leaves.select("path", "value").distinct().groupBy("path").agg(F.count("*").alias("n_values"))
    parent = F.regexp_replace("node", "/[^/]*$", "")
    tree = per_row.join(values, per_row["node"] == values["path"], "left")
    return tree.select(F.col("node").alias("path"), F.when(parent != "", parent).alias("parent"), (F.size(F.split("node", "/")) - 1).alias("depth"), "n_rows", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"))


def xml_candidates(index: DataFrame, column: str, low: int, high: int, key: str = "id") -> DataFrame:
    """Equality queries on leaves (``eq-double-slash``, by tag) and whole paths (``eq-full``) with ``low`` to ``high`` rows.

    Both come from one pass over (row, path, value): a path's values are the
    leaves of the path summary, a tag's are those of all paths that end in it.
    """
    shown = F.upper("value")
    asked = F.array(F.struct(F.lit("eq-full").alias("sub_category"), F.col("path").alias("xpath")), F.struct(F.lit("eq-double-slash").alias("sub_category"), F.concat(F.lit("//"), "tag").alias("xpath")))
    # a row's entries meet in one task before they are told apart, so no task holds those of all it has read
    met = index.select(key, "path", "tag", "value").repartition(key).select(key, shown.alias("v"), F.explode(asked).alias("a")).select(key, "v", "a.*").distinct()
    found = met.groupBy("sub_category", "xpath", "v").agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    literal = F.when(F.col("v").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.col("v")).otherwise(quoted(F.col("v")))
    text = F.concat(F.lit(f"xml_value({column}, "), quoted(F.col("xpath")), F.lit(", "), literal, F.lit(")"))
    return found.select(F.lit("P11").alias("category"), "sub_category", F.lit(column).alias("field"), "xpath", F.col("v").alias("search_for"), text.alias("where"), "n")


# -- word proximity -----------------------------------------------------------------------------------------


def alarm_candidates(index: DataFrame, low: int, high: int) -> DataFrame:
    """For each pair of alarm words the least distance within which ``low`` to ``high`` rows have both.

    ``index``: rows (word1, word2, field, distance) of a proximity index. Rows
    are counted by distance and summed in its order; the sum is inverted to the
    first distance that reaches ``low``, and pairs that leap over ``high`` there
    are left out.
    """
    pair = ["field", "word1", "word2"]
    histogram = index.groupBy(*pair, "distance").agg(F.count("*").alias("at"))
    within = cumulative(histogram, ["distance"], "at", "n", by=pair)
    first = within.where((F.col("n") >= low) & (F.col("n") - F.col("at") < low) & (F.col("n") <= high))
    near = F.concat(F.lit("WORD_PROXIMITY("), "field", F.lit(", "), quoted(F.col("word1")), F.lit(", "), quoted(F.col("word2")), F.lit(")"))
    text = F.concat(near, F.lit(" <= "), F.col("distance").cast("string"), F.lit(" ORDER BY "), near)
    return first.select(F.lit("P9").alias("category"), F.lit("alarm-words").alias("sub_category"), *pair, "distance", text.alias("where"), "n")


# -- ranges of numbers spread over many orders of magnitude -----------------------------------------------------


def bit_length(c: str | Column) -> Column:
    """Bits of a number from 0 to 2^64 - 1, of any integral type."""
    c = (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(c >= top, 64).when(c <= 0, 0).otherwise(F.length(F.bin(c.cast("long"))))


def _power(b: Column) -> Column:
    """2^b for b from 0 to 63, exactly."""
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(b, F.lit(62)).cast("int")).cast("decimal(20,0)")
    return F.when(b >= 63, F.lit(str(1 << 63)).cast("decimal(20,0)")).otherwise(half)


def densities(rows: DataFrame, field: str) -> DataFrame:
    """(bits, n, density): rows a number for each of the 65 bit lengths, those without rows included."""
    counts = rows.where(F.col(field).isNotNull()).groupBy(bit_length(field).alias("bits")).agg(F.count("*").alias("n"))
    lengths = rows.sparkSession.range(65).select(F.col("id").cast("int").alias("bits"))
    size = F.when(F.col("bits") == 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.col("bits") - 1))
    return lengths.join(counts, "bits", "left").select("bits", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / size).alias("density"))


def _hash32(*parts: Column) -> Column:
    """32 bits that the parts fix, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def log_ranges(rows: DataFrame, field: str, exponents: Sequence[int], wanted: int, tries: int, seed: int) -> DataFrame:
    """(exponent, try, bits, low, high, n): ranges of 2^exponent numbers that about ``wanted`` rows should be in, and those that are.

    The wanted rows over the range's size is a density; of the bit lengths that
    have it within one half, and are long enough to hold the range, a draw takes
    one, and another the range's place in it. Ranges lie within one bit length,
    so rows meet them on it.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(e, t) for e in exponents for t in range(tries)], "exponent int, try int")
    ratio = F.col("density") * F.pow(F.lit(2.0), F.col("exponent")) / wanted
    fits = asked.join(F.broadcast(densities(rows, field)), (F.col("bits") >= F.col("exponent") + 2) & (ratio >= 0.5) & (ratio <= 1.5))  # 65 rows
    drawn = F.min(F.struct(_hash32(F.lit(seed), F.col("exponent"), F.col("try"), F.col("bits")).alias("h"), "bits")).alias("d")
    chosen = fits.groupBy("exponent", "try").agg(drawn).select("exponent", "try", "d.bits")
    whole = lambda c: c.cast("decimal(38,0)")
    room = whole(_power(F.col("bits") - 1) - _power(F.col("exponent")) + 1)
    place = F.call_function("div", whole(_hash32(F.lit(seed), F.lit("place"), F.col("exponent"), F.col("try"))) * room.cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(20,0)"))
    low = (_power(F.col("bits") - 1) + place.cast("decimal(20,0)")).cast("decimal(20,0)")
    ranges = chosen.select("exponent", "try", "bits", low.alias("low")).withColumn("high", (F.col("low") + _power(F.col("exponent")) - 1).cast("decimal(20,0)"))
    at = rows.select(bit_length(field).alias("bits"), F.col(field).cast("decimal(20,0)").alias("v"))
    hits = at.join(F.broadcast(ranges), "bits").where("v >= low and v <= high").groupBy("exponent", "try").agg(F.count("*").alias("n"))  # len(exponents) x tries rows
    return ranges.join(hits, ["exponent", "try"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def one_an_exponent(ranges: DataFrame, low: int, high: int) -> DataFrame:
    """The first try of each exponent whose count is ``low`` to ``high``."""
    good = ranges.where(F.col("n").between(low, high))
    return good.join(good.groupBy("exponent").agg(F.min("try").alias("try")), ["exponent", "try"], "left_semi")
