"""Row predicates as Columns.

Strings and labels are compared in upper case on both sides; numbers and dates
compare as they are. A missing value gives null, which a filter drops;
``m_of_n`` counts it as false. Everything is built-in expressions, so filters
reach the scan and stay in generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .scalars import upper, upper_text

Value = str | int | float | date | datetime | None


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci(c: str | Column, value: Value) -> tuple[Column, Column]:
    """Both sides of a comparison, upper-cased where the value is a string."""
    return (F.upper(_c(c)), F.lit(value.upper())) if isinstance(value, str) else (_c(c), F.lit(value))


def eq(c: str | Column, value: Value) -> Column:
    a, b = ci(c, value)
    return a == b


def ne(c: str | Column, value: Value) -> Column:
    a, b = ci(c, value)
    return a != b


def le(c: str | Column, value: Value) -> Column:
    """The "less than" of the query language, which includes the bound."""
    a, b = ci(c, value)
    return a <= b


def ge(c: str | Column, value: Value) -> Column:
    a, b = ci(c, value)
    return a >= b


def between(c: str | Column, low: Value = None, high: Value = None) -> Column:
    """Inclusive at both ends; a bound of None is open. Raises if the bounds are the wrong way round."""
    if low is not None and high is not None and (low.upper() if isinstance(low, str) else low) > (high.upper() if isinstance(high, str) else high):
        raise ValueError("lower bound above upper bound")
    parts = ([ge(c, low)] if low is not None else []) + ([le(c, high)] if high is not None else [])
    return reduce(and_, parts) if parts else _c(c).isNotNull()


def where(function: Callable[..., Column], *fields: str) -> Column:
    """A predicate of the user's own over the fields it declares."""
    return function(*map(F.col, fields))


def words(c: str | Column, shown: Callable[[Column], Column] = upper) -> Column:
    """The distinct words of a text in upper case, as ``shown`` makes it, without spaces and punctuation."""
    return F.array_distinct(F.filter(F.split(shown(_c(c)), r"[^\p{L}\p{N}']+"), lambda w: w != ""))


def contains_word(c: str | Column, word: str, match_case: bool = False) -> Column:
    if match_case:
        return F.array_contains(F.split(_c(c), r"[^\p{L}\p{N}']+"), word)
    return F.array_contains(words(c), upper_text(word))


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def wild_first(c: str | Column, value: str, n: int = 1) -> Column:
    """``n`` characters that can be any, then ``value``."""
    if n < 1:
        raise ValueError("at least one character")
    return (F.length(_c(c)) >= n) & (F.substring(F.upper(_c(c)), n + 1, 1 << 30) == value.upper())


def wild_last(c: str | Column, value: str, n: int = 1) -> Column:
    """``value``, then ``n`` characters that can be any."""
    if n < 1:
        raise ValueError("at least one character")
    return (F.length(_c(c)) == len(value) + n) & F.upper(_c(c)).startswith(value.upper())


def wild(c: str | Column, pieces: Sequence[str], n: int = 1, more_before: bool = False, more_after: bool = False, backtrack: bool = False) -> Column:
    """``pieces`` with exactly ``n`` characters between neighbours.

    Anchored at both ends unless more text is allowed there. With more on both
    sides only the first place of the first piece is tried, unless ``backtrack``
    asks for the usual meaning of a pattern.
    """
    value = F.upper(_c(c))
    body = f".{{{n}}}".join(_quoted(p.upper()) for p in pieces)
    if more_before and more_after and not backtrack:
        at = F.locate(pieces[0].upper(), value)
        return (at > 0) & F.substr(value, F.greatest(at, F.lit(1))).rlike(f"(?s)^{body}")
    return value.rlike(f"(?s){'' if more_before else '^'}{body}{'' if more_after else '$'}".replace("$", r"\z"))


def ends(c: str | Column, value: str) -> Column:
    """``%abc``."""
    return F.upper(_c(c)).endswith(value.upper())


def has(c: str | Column, value: str) -> Column:
    """``%abc%``."""
    return F.upper(_c(c)).contains(value.upper())


def starts(c: str | Column, value: str) -> Column:
    """``abc%``."""
    return F.upper(_c(c)).startswith(value.upper())


def prefix(c: str | Column, n: int = 9) -> Column:
    return F.substring(_c(c), 1, n)


def all_of(*terms: Column) -> Column:
    return reduce(and_, terms)


def any_of(*terms: Column) -> Column:
    return reduce(or_, terms)


def none(term: Column) -> Column:
    return ~term


def m_of_n(m: int, *terms: Column) -> Column:
    """The number of true terms if it is ``m`` or more, else 0."""
    count = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for t in terms])
    return F.when(count >= m, count).otherwise(0)


def register(spark: SparkSession) -> None:
    """``m_of_n(m, array(term, ...))`` as a SQL function of the session, with the meaning of :func:`m_of_n`.

    Its body is SQL, so plans see through it as they do through a written-out sum.
    """
    count = "size(filter(terms, t -> coalesce(t, false)))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION m_of_n(m INT, terms ARRAY<BOOLEAN>) RETURNS INT RETURN CASE WHEN {count} >= m THEN {count} ELSE 0 END")


def xpath_exists(c: str | Column, path: str) -> Column:
    return F.coalesce(F.size(F.xpath(_c(c), F.lit(f"{path}/text()"))) > 0, F.lit(False))


def xpath_equals(c: str | Column, path: str, value: str) -> Column:
    return F.coalesce(F.exists(F.xpath(_c(c), F.lit(f"{path}/text()")), lambda v: F.upper(v) == value.upper()), F.lit(False))


@dataclass(frozen=True)
class Predicate:
    """One structured predicate with three forms: Column, row of a query table, text.

    ``kind``: eq ne le ge range word starts ends has and or not mofn.
    """

    kind: str
    field: str = ""
    value: Value = None
    low: Value = None
    high: Value = None
    m: int = 0
    terms: tuple["Predicate", ...] = ()

    def column(self) -> Column:
        simple = {"eq": eq, "ne": ne, "le": le, "ge": ge, "word": contains_word, "starts": starts, "ends": ends, "has": has}
        if self.kind in simple:
            return simple[self.kind](self.field, self.value)
        if self.kind == "range":
            return between(self.field, self.low, self.high)
        inner = [t.column() for t in self.terms]
        if self.kind == "and":
            return all_of(*inner)
        if self.kind == "or":
            return any_of(*inner)
        if self.kind == "not":
            return none(inner[0])
        if self.kind == "mofn":
            return m_of_n(self.m, *inner) > 0
        raise ValueError(f"unknown kind {self.kind}")

    def text(self) -> str:
        quote = lambda v: "'" + str(v).upper().replace("'", "''") + "'" if isinstance(v, str) else str(v) if not isinstance(v, (date, datetime)) else f"'{v}'"
        name = lambda v: f"upper({self.field})" if isinstance(v, str) else self.field
        signs = {"eq": "=", "ne": "<>", "le": "<=", "ge": ">="}
        if self.kind in signs:
            return f"{name(self.value)} {signs[self.kind]} {quote(self.value)}"
        if self.kind == "range":
            parts = [f"{name(v)} {s} {quote(v)}" for v, s in ((self.low, ">="), (self.high, "<=")) if v is not None]
            return "(" + (" AND ".join(parts) or f"{self.field} IS NOT NULL") + ")"
        if self.kind == "word":
            return f"CONTAINED_IN({self.field}, {quote(self.value)})"
        if self.kind in ("starts", "ends", "has"):
            like = quote(self.value)[1:-1]
            return f"upper({self.field}) LIKE '{'%' * (self.kind != 'starts')}{like}{'%' * (self.kind != 'ends')}'"
        inner = [t.text() for t in self.terms]
        if self.kind == "not":
            return f"NOT ({inner[0]})"
        if self.kind == "mofn":
            return f"M_OF_N({self.m}, {len(inner)}, {', '.join(inner)})"
        return "(" + f" {self.kind.upper()} ".join(inner) + ")"

    def row(self, qid: int) -> tuple:
        """(qid, kind, field, value, low, high, m, n, where) for a query table."""
        show = lambda v: None if v is None else str(v)
        return qid, self.kind, self.field or None, show(self.value), show(self.low), show(self.high), self.m or None, len(self.terms) or None, self.text()


#: The columns of :meth:`Predicate.row`.
ROW = "qid long, kind string, field string, value string, low string, high string, m int, n int, where string"


def depth(p: Predicate) -> int:
    return 1 + max(map(depth, p.terms)) if p.terms else 0


def shape(p: Predicate) -> dict[str, int]:
    """Largest fan-in of ORs and ANDs, depth, and m and n of a threshold, from the structure itself."""
    found = {"or_fan_in": 0, "and_fan_in": 0, "depth": depth(p), "m": 0, "n": 0}

    def visit(q: Predicate) -> None:
        if q.kind in ("or", "and"):
            found[f"{q.kind}_fan_in"] = max(found[f"{q.kind}_fan_in"], len(q.terms))
        if q.kind == "mofn":
            found["m"], found["n"] = q.m, len(q.terms)
        for t in q.terms:
            visit(t)

    visit(p)
    return found


#: Tokens of a WHERE text: quoted text, brackets, commas, numbers and words; signs say nothing of the shape.
TOKENS = r"'(?:[^']|'')*'|[(),]|[\p{L}_][\p{L}\p{N}_.]*|[0-9][0-9.]*"
_FRAME = "struct<kind:string,negated:boolean,ors:int,ands:int,run:int,longest:int,depth:int,inner_or:boolean,inner:boolean,commas:int>"
_STATE = f"struct<stack:array<{_FRAME}>,last:string,or_fan_in:int,and_fan_in:int,depth:int,terms:int,m:int,n:int,dnf:boolean>"


def text_shape(where: str | Column) -> Column:
    """or_fan_in, and_fan_in, depth, terms, m, n and dnf of a WHERE text, by one fold of a stack over its tokens.

    Brackets open a frame, of a group, of a function's arguments or of an
    ``M_OF_N``; AND and OR count in their frame, AND binding closer, so a run of
    ANDs between ORs is one conjunction. A closed frame hands its depth on: each
    kind of connective, a threshold and a NOT before brackets are a level.
    ``terms`` are the leaves, a range as two. ``m`` and ``n`` are those of the
    last threshold, 0 without one. ``dnf`` is whether the text is an OR of ANDs of
    leaves and negated leaves. Quoted text is never looked into, and brackets
    that do not match end what they can. Null stays null; the empty text has no terms.
    """
    frame = lambda kind, negated: F.struct(
        kind.alias("kind"), negated.alias("negated"), *[F.lit(0).alias(n) for n in ("ors", "ands", "run", "longest", "depth")], F.lit(False).alias("inner_or"), F.lit(False).alias("inner"), F.lit(0).alias("commas")
    )
    zero = F.struct(
        F.array(frame(F.lit("group"), F.lit(False))).alias("stack"), F.lit("").alias("last"), *[F.lit(0).alias(n) for n in ("or_fan_in", "and_fan_in", "depth")],
        F.lit(1).alias("terms"), F.lit(0).alias("m"), F.lit(0).alias("n"), F.lit(True).alias("dnf"),
    ).cast(_STATE)

    def closed(s: Column) -> Column:
        """The state after its top frame has ended, below which another one stands."""
        top, under = F.element_at(s["stack"], -1), F.element_at(s["stack"], -2)
        group, many = top["kind"] == "group", top["kind"] == "m_of_n"
        own = F.when(group, (top["ors"] > 0).cast("int") + (top["ands"] > 0).cast("int")).when(many, 1).otherwise(0)
        depth = top["depth"] + own + top["negated"].cast("int")
        compound = top["inner"] | (group & (top["ors"] + top["ands"] > 0)) | many
        has_or = top["inner_or"] | (group & (top["ors"] > 0)) | many
        good = ~((top["ands"] > 0) & top["inner_or"]) & ~(top["negated"] & compound) & ~many
        raised = under.withField("depth", F.greatest(under["depth"], depth)).withField("inner_or", under["inner_or"] | has_or).withField("inner", under["inner"] | compound)
        rest = F.concat(F.slice(s["stack"], 1, F.size(s["stack"]) - 2), F.array(raised))
        return tallied(s, top).withField("stack", rest).withField("dnf", s["dnf"] & good)

    def tallied(s: Column, top: Column) -> Column:
        group = top["kind"] == "group"
        ands = F.greatest(top["longest"], top["run"])
        s = s.withField("or_fan_in", F.greatest(s["or_fan_in"], F.when(group & (top["ors"] > 0), top["ors"] + 1).otherwise(0)))
        return s.withField("and_fan_in", F.greatest(s["and_fan_in"], F.when(group & (ands > 0), ands + 1).otherwise(0)))

    def step(s: Column, token: Column) -> Column:
        word = F.when(token.startswith("'"), F.lit("'")).otherwise(F.upper(token))
        top = F.element_at(s["stack"], -1)
        put = lambda changed: s.withField("stack", F.concat(F.slice(s["stack"], 1, F.size(s["stack"]) - 1), F.array(changed)))
        kind = F.when(s["last"] == "M_OF_N", "m_of_n").when(s["last"].rlike(r"^[\p{L}_]") & ~s["last"].isin("AND", "OR", "NOT"), "call").otherwise("group")
        opened = s.withField("stack", F.concat(s["stack"], F.array(frame(kind, s["last"] == "NOT").cast(_FRAME))))
        ored = put(top.withField("ors", top["ors"] + 1).withField("longest", F.greatest(top["longest"], top["run"])).withField("run", F.lit(0))).withField("terms", s["terms"] + 1)
        anded = put(top.withField("ands", top["ands"] + 1).withField("run", top["run"] + 1)).withField("terms", s["terms"] + 1)
        many = top["kind"] == "m_of_n"
        number = F.coalesce(token.try_cast("int"), F.lit(0))
        told = F.when(top["commas"] == 0, s.withField("m", number)).otherwise(s.withField("n", number).withField("terms", s["terms"] + F.greatest(number - 1, F.lit(0))))
        after = (
            F.when(word == "(", opened).when((word == ")") & (F.size(s["stack"]) > 1), closed(s)).when(word == "OR", ored).when(word == "AND", anded)
            .when(word == ",", put(top.withField("commas", top["commas"] + 1))).when(many & (top["commas"] < 2) & token.rlike("^[0-9]"), told).otherwise(s)
        )
        return after.withField("last", word)

    def finish(s: Column) -> Column:
        top = F.element_at(s["stack"], -1)
        t = tallied(s, top)
        depth = top["depth"] + (top["ors"] > 0).cast("int") + (top["ands"] > 0).cast("int")
        good = s["dnf"] & ~((top["ands"] > 0) & top["inner_or"])
        terms = F.when(s["last"] == "", 0).otherwise(s["terms"])
        return F.struct(t["or_fan_in"].alias("or_fan_in"), t["and_fan_in"].alias("and_fan_in"), depth.alias("depth"), terms.alias("terms"), s["m"].alias("m"), s["n"].alias("n"), good.alias("dnf"))

    return F.aggregate(F.regexp_extract_all(_c(where), F.lit(TOKENS), F.lit(0)), zero, step, finish)
