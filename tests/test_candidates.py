"""Candidate generators and combinations of terms against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sextant.operators import candidates, combine, textindex, workload


@pytest.fixture(scope="module")
def postings(spark):
    """Twelve terms on seven fields over 400 rows, as frames and as sets."""
    pick = random.Random(3)
    fields = {q: f"f{q % 7}" for q in range(12)}
    rows = {q: {i for i in range(400) if pick.random() < 0.35 + 0.05 * (q % 7)} for q in range(12)}
    hits = spark.createDataFrame([(q, i) for q in rows for i in rows[q]], "qid long, id long").repartition(3)
    return rows, fields, hits.union(hits.limit(20)), spark.createDataFrame(list(fields.items()), "qid long, field string")


@pytest.mark.parametrize(("n", "low", "high", "first"), [(1, 1, 10_000, (0, 10_000)), (2, 60, 90, (0, 1_000)), (4, 10, 40, (150, 200)), (6, 2, 9, (0, 180))])
def test_conjunctions_of_up_to_six_terms(postings, n, low, high, first):
    rows, fields, hits, terms = postings
    want = {}
    for combo in itertools.combinations(rows, n):
        common = len(set.intersection(*(rows[q] for q in combo)))
        firsts = sorted((len(rows[q]), q) for q in combo if first[0] <= len(rows[q]) <= first[1])
        if len({fields[q] for q in combo}) == n and low <= common <= high and firsts:
            want[combo] = (firsts[0][1], firsts[0][0], common)
    got = {tuple(sorted(r.terms)): (r.first, r.n_first, r.n) for r in combine.conjunctions(hits, terms, n, low, high, *first).collect()}
    assert want and got == want


@pytest.mark.parametrize(("n", "low", "high", "total"), [(2, 250, 300, (0, 10_000)), (3, 300, 340, (500, 560)), (4, 0, 372, (0, 830))])
def test_unions_of_several_terms(postings, n, low, high, total):
    rows, fields, hits, terms = postings
    want = {}
    for combo in itertools.combinations(rows, n):
        either, added = len(set.union(*(rows[q] for q in combo))), sum(len(rows[q]) for q in combo)
        if len({fields[q] for q in combo}) == n and low <= either <= high and total[0] <= added <= total[1]:
            want[combo] = (added, either)
    got = {tuple(r.terms): (r.n_sum, r.n) for r in combine.unions(hits, terms, n, low, high, *total).collect()}
    assert want and got == want


def test_texts_name_the_first_term_first(spark, postings):
    rows, _, hits, terms = postings
    found = combine.conjunctions(hits, terms, 3, 30, 40, 160, 170)
    where = terms.select("qid", F.concat(F.lit("t"), "qid").alias("where"))
    out = combine.texts(found, hits.distinct(), where).collect()
    assert out
    for r in out:
        order = [int(t[1:]) for t in r.where_clause.split(" AND ")]
        second = min((q for q in r.terms if q != r.first), key=lambda q: (len(rows[r.first] & rows[q]), q))
        assert order[:2] == [r.first, second] and sorted(order) == sorted(r.terms)


def test_no_terms_and_no_matches(spark):
    hits, terms = spark.createDataFrame([], "qid long, id long"), spark.createDataFrame([], "qid long, field string")
    assert combine.conjunctions(hits, terms, 2, 1, 5).count() == 0 and combine.unions(hits, terms, 2, 1, 5).count() == 0
    with pytest.raises(ValueError):
        combine.conjunctions(hits, terms, 2, 0, 5)


def like(pattern: str) -> re.Pattern:
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    return re.compile(out, re.S)


def test_patterns_count_what_they_match(spark):
    values = ["Anna", "anne", "Hanna", "x", "", None, "a%b_c\\d", "A_B", "100%'s", "middleword", "middlewird", "mudd lewird", "anna", "été à gogo"]
    rows = spark.createDataFrame([(v,) for v in values], "name string")
    found = candidates.masked(rows, "name", [2, 5]).collect()
    upper = [v.upper() for v in values if v is not None]
    assert all(r.n == sum(bool(like(r.pattern).fullmatch(v)) for v in upper) for r in found)
    kinds = {(r.sub_category, r.pattern) for r in found}
    assert {("final-one", "ANN_"), ("initial-one", "_NNA"), ("middle-one", "MIDD_EWORD"), ("both", "%NN%"), ("final", "A\\%%"), ("initial", "%GO"), ("final-one", "A\\__")} <= kinds
    assert not any(k == "middle-one" and len(p.replace("\\", "")) < 9 for k, p in kinds) and len(kinds) == len(found)
    # the texts work as they stand
    rows.createOrReplaceTempView("pattern_rows")
    asked = candidates.wildcard_candidates(rows, "name", [2], 2, 9).collect()
    for r in asked:
        assert spark.sql(f"SELECT count(*) FROM pattern_rows WHERE {r['where']}".replace("\\", "\\\\")).first()[0] == r.n
    few = candidates.pick(candidates.wildcard_candidates(rows, "name", [2], 1, 9), 1, 5)
    assert {r.c for r in few.groupBy("category", "sub_category").agg(F.count("*").alias("c")).collect()} == {2}


def test_xml_counts_a_row_once(spark):
    docs = [(1, "<xml><a><b>X</b><b>x</b></a><c>7</c></xml>"), (2, "<xml><a><b>x</b></a><d><b>Y</b></d></xml>"), (3, "no xml"), (4, "<xml><c>o'k</c></xml>")]
    index = textindex.xml_paths(spark.createDataFrame(docs, "id long, xml string"), "id", "xml")
    where = {r["where"]: r.n for r in candidates.xml_candidates(index, "xml", 1, 9).collect()}
    assert where == {
        "xml_value(xml, '/xml/a/b', 'X')": 2, "xml_value(xml, '/xml/c', 7)": 1, "xml_value(xml, '/xml/d/b', 'Y')": 1, "xml_value(xml, '/xml/c', 'O''K')": 1,
        "xml_value(xml, '//b', 'X')": 2, "xml_value(xml, '//c', 7)": 1, "xml_value(xml, '//b', 'Y')": 1, "xml_value(xml, '//c', 'O''K')": 1,
    }
    tree = {r.path: (r.parent, r.depth, r.n_rows, r.n_values) for r in candidates.path_summary(index).collect()}
    assert tree == {"/xml": (None, 1, 3, 0), "/xml/a": ("/xml", 2, 2, 0), "/xml/a/b": ("/xml/a", 3, 2, 2), "/xml/c": ("/xml", 2, 2, 2), "/xml/d": ("/xml", 2, 1, 0), "/xml/d/b": ("/xml/d", 3, 1, 1)}


def test_proximity_takes_the_first_distance_that_is_enough(spark):
    rows = [("t", "A", "B", x) for x in (1, 1, 4, 9, 9, 9)] + [("t", "A", "C", 5)] * 9 + [("t", "B", "C", 2)] * 2
    found = candidates.alarm_candidates(spark.createDataFrame(rows, "field string, word1 string, word2 string, distance int"), 3, 5).collect()
    assert [(r.word1, r.word2, r.distance, r.n, r["where"]) for r in found] == [("A", "B", 4, 3, "WORD_PROXIMITY(t, 'A', 'B') <= 4 ORDER BY WORD_PROXIMITY(t, 'A', 'B')")]


def test_ranges_of_numbers_hold_about_the_wanted_rows(spark):
    from sextant.operators.synth import log_uniform

    rows = spark.range(30_000).select(log_uniform(5, F.col("id")).alias("v")).cache()
    found = candidates.log_ranges(rows, "v", range(2, 60, 4), 60, 3, 1).collect()
    values = [int(r.v) for r in rows.collect()]
    assert len(found) > 30
    for r in found:
        low, high = int(r.low), int(r.high)
        assert high - low + 1 == 1 << r.exponent and low.bit_length() == high.bit_length() == r.bits and r.n == sum(low <= v <= high for v in values)
        assert 15 <= r.n <= 130
    one = candidates.one_an_exponent(candidates.log_ranges(rows, "v", range(2, 60, 4), 60, 3, 1), 30, 90).collect()
    assert len({r.exponent for r in one}) == len(one) > 10 and all(30 <= r.n <= 90 for r in one)


def test_bit_lengths_up_to_64(spark):
    import decimal

    numbers = [0, 1, 2, 3, 4, 255, 256, (1 << 62) - 1, 1 << 62, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    rows = spark.createDataFrame([(decimal.Decimal(n),) for n in numbers], "v decimal(20,0)")
    assert [r.b for r in rows.select(candidates.bit_length("v").alias("b")).collect()] == [n.bit_length() for n in numbers]


def test_reordering_can_be_told_its_first_term(spark):
    hits = spark.createDataFrame([(1, i) for i in range(2)] + [(2, i) for i in range(5)] + [(3, i) for i in range(1, 4)], "qid long, id long")
    combos = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "cid long, qid long, first boolean")
    assert [r.qid for r in workload.reorder(combos, hits, "first").orderBy("pos").collect()] == [2, 1, 3]
    assert [r.qid for r in workload.reorder(combos.drop("first"), hits).orderBy("pos").collect()] == [1, 3, 2]


def test_shape_of_texts_equals_that_of_the_structure(spark):
    from sextant.functions import predicates as P

    pick = random.Random(8)

    def made(level: int) -> P.Predicate:
        kind = pick.choice(["eq", "word", "starts"] if level == 0 else ["and", "or", "mofn", "not", "eq"])
        if kind in ("and", "or", "mofn"):
            terms = tuple(made(level - 1) for _ in range(pick.randint(2, 4)))
            return P.Predicate(kind, m=pick.randint(1, len(terms)), terms=terms)
        if kind == "not":
            return P.Predicate("not", terms=(made(level - 1),))
        return P.Predicate(kind, "f", pick.choice(["x", "it's (odd", "a AND b", "100%, or not"]))

    def leaves(p: P.Predicate) -> int:
        return sum(map(leaves, p.terms)) if p.terms else 1

    def dnf(p: P.Predicate, under: str = "") -> bool:
        """An OR of ANDs of leaves; ORs within ORs and ANDs within ANDs count as one."""
        if not p.terms:
            return True
        if p.kind == "not":
            return not p.terms[0].terms or (p.terms[0].kind == "not" and dnf(p.terms[0]))
        if p.kind == "mofn":
            return False
        if p.kind == "or" and under == "and":
            return False
        return all(dnf(t, "and" if "and" in (p.kind, under) else "or") for t in p.terms)

    trees = [made(pick.randint(0, 3)) for _ in range(120)]
    rows = spark.createDataFrame([(i, p.text()) for i, p in enumerate(trees)], "i int, w string")
    for r in rows.select("i", "w", P.text_shape("w").alias("s")).collect():
        p, s = trees[r.i], r.s
        want = P.shape(p)
        assert (s.or_fan_in, s.and_fan_in, s.depth, s.terms) == (want["or_fan_in"], want["and_fan_in"], want["depth"], leaves(p)), r.w
        assert s.dnf == dnf(p), r.w
        if r.w.count("M_OF_N") == 1:
            assert (s.m, s.n) == (want["m"], want["n"])
