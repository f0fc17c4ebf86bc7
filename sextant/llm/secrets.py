"""Secret scans by one combined deterministic automaton.

The rules' regexes become one nondeterministic automaton, subset construction
makes it deterministic, and partition refinement makes it minimal. Its
transition array takes a text's bytes once, whatever the number of rules. A
state tells which rules have just got enough to match; the few places where
that happens are settled there and then: the start is found by looking back,
the end by running on, as leftmost matching does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as _op
from re import _parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import scan, table

#: Parts of the base rules.
KEYS = rb"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BETWEEN = rb"[\"']?\x20*[:=]\x20*[\"']?"
VALUE = rb"[A-Za-z0-9+/_.=-]"


class Rule:
    """``opens``, all that the automaton looks for, settles a start at its last byte;
    ``back`` finds the start; ``whole``, matched there, gives the end.

    ``opens`` is kept short: counted repeats that can overlap multiply the states.

    Matches with fewer than ``fewest`` characters in group 1 take up their
    characters but are dropped.
    """

    def __init__(self, kind: str, opens: bytes, back: bytes, whole: bytes, fewest: int) -> None:
        self.kind, self.opens, self.fewest = kind, opens, fewest
        self.back, self.whole, self.shortest = re.compile(back), re.compile(whole), re.compile(opens)


#: Base rules, in the order that breaks ties.
BASE = (
    Rule("assign", KEYS + BETWEEN + VALUE, KEYS, KEYS + BETWEEN + b"(" + VALUE + b"+)", 8),
    Rule("access", rb"AKIA[A-Z0-9]", rb"AKIA", rb"(AKIA[A-Z0-9]+)", 16),
    Rule("hex", rb"[0-9a-f]{32}", rb"[0-9a-f]", rb"([0-9a-f]+)", 32),
)
#: What the method adds: published forms of well-known credentials.
MORE = (
    Rule("private_key", rb"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY", rb"-----BEGIN ", rb"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----)", 27),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]", rb"gh[pousr]_", rb"(gh[pousr]_[A-Za-z0-9]+)", 40),
    Rule("slack", rb"xox[baprs]-[A-Za-z0-9-]", rb"xox[baprs]-", rb"(xox[baprs]-[A-Za-z0-9-]+)", 15),
    Rule("google", rb"AIza[A-Za-z0-9_-]", rb"AIza", rb"(AIza[A-Za-z0-9_-]+)", 39),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]", rb"eyJ", rb"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 20),
)


def _bytes_of(items: list) -> frozenset[int]:
    found: set[int] = set()
    for op, value in items:
        if op is _op.RANGE:
            found.update(range(value[0], value[1] + 1))
        elif op is _op.LITERAL:
            found.add(value)
        else:
            raise ValueError(f"not usable in a rule: {op}")
    return frozenset(found)


class _Nfa:
    """Thompson's construction over the parsed regexes."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, parsed, at: int) -> int:
        for op, value in parsed:
            if op in (_op.LITERAL, _op.IN):
                after = self.state()
                self.moves[at].append((_bytes_of([(op, value)] if op is _op.LITERAL else value), after))
                at = after
            elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT):
                least, most, inner = value
                for _ in range(least):
                    at = self.add(inner, at)
                after = self.state()
                self.free[at].append(after)
                if most is _op.MAXREPEAT:
                    self.free[self.add(inner, after)].append(after)
                else:
                    end = self.state()
                    self.free[after].append(end)
                    for _ in range(most - least):
                        after = self.add(inner, after)
                        self.free[after].append(end)
                    after = end
                at = after
            elif op is _op.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.free[self.add(branch, at)].append(end)
                at = end
            elif op is _op.SUBPATTERN:
                at = self.add(value[3], at)
            else:
                raise ValueError(f"not usable in a rule: {op}")
        return at


def compile_rules(patterns: list[bytes]) -> tuple[list[int], dict[int, tuple[int, ...]], int]:
    """The minimal automaton that finds ends of the patterns anywhere in a text.

    Returns the transition array (state * 256 + byte -> state * 256), the
    patterns that end in each accepting state, and the first accepting state;
    accepting states come last, so one comparison tells them.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for k, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.free[start].append(first)
        ends[nfa.add(_parser.parse(pattern), first)] = k

    def closed(states) -> frozenset[int]:
        found, left = set(states), list(states)
        while left:
            for s in nfa.free[left.pop()]:
                if s not in found:
                    found.add(s)
                    left.append(s)
        return frozenset(found)

    # subset construction; the start set is in every set, as a match may begin anywhere
    begin = closed([start])
    number, sets, rows = {begin: 0}, [begin], []
    while len(rows) < len(sets):
        moves: dict[int, set[int]] = {}
        for s in sets[len(rows)]:
            for chars, after in nfa.moves[s]:
                for c in chars:
                    moves.setdefault(c, set()).add(after)
        row, made = [0] * 256, {}
        for c, after in moves.items():
            key = frozenset(after)
            if key not in made:
                whole = closed(after) | begin
                if whole not in number:
                    number[whole] = len(sets)
                    sets.append(whole)
                made[key] = number[whole]
            row[c] = made[key]
        rows.append(row)
    accepts = [tuple(sorted(ends[s] for s in whole if s in ends)) for whole in sets]
    # partition refinement until no block splits
    block_of = accepts
    names = {a: i for i, a in enumerate(sorted(set(accepts)))}
    block = [names[a] for a in block_of]
    while True:
        signatures = [(block[s], *map(block.__getitem__, rows[s])) for s in range(len(rows))]
        names = {}
        refined = [names.setdefault(x, len(names)) for x in signatures]
        if len(names) == len(set(block)):
            break
        block = refined
    # number the blocks anew, accepting ones last
    first_of = {}
    for s, b in enumerate(block):
        first_of.setdefault(b, s)
    order = sorted(first_of.values(), key=lambda s: (bool(accepts[s]), s))
    if order[0] != 0:
        raise ValueError("a pattern matches the empty text")
    place = {block[s]: i for i, s in enumerate(order)}
    table = [place[block[t]] << 8 for s in order for t in rows[s]]
    return table, {place[block[s]] << 8: accepts[s] for s in order if accepts[s]}, min(i for i, s in enumerate(order) if accepts[s]) << 8


@lru_cache(maxsize=2)
def _automaton(more: bool) -> tuple:
    rules = (*BASE, *MORE) if more else BASE
    return rules, *compile_rules([r.opens for r in rules])


def hits(data: bytes, table: list[int], first: int) -> Iterator[tuple[int, int]]:
    """(position after the byte, state) wherever a rule has got enough."""
    state = 0
    for at, byte in enumerate(data, 1):
        state = table[state | byte]
        if state >= first:
            yield at, state


def find(data: bytes, more: bool = True) -> list[tuple[int, int, int]]:
    """(rule number, start, end) in bytes, leftmost non-overlapping for each rule, by start and rule."""
    rules, table, accepts, first = _automaton(more)
    taken = [0] * len(rules)
    found = []
    for at, state in hits(data, table, first):
        for k in accepts[state]:
            rule = rules[k]
            if at <= taken[k]:
                continue  # inside the last match
            start = _start(rule, data, at, taken[k])
            m = rule.whole.match(data, start) if start is not None else None
            if m is None:
                continue
            taken[k] = m.end()
            if len(m[1]) >= rule.fewest:
                found.append((k, start, m.end()))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _start(rule: Rule, data: bytes, at: int, after: int) -> int | None:
    """Where the match begins whose first settled byte is at ``at`` - 1; none before ``after``."""
    if rule.kind == "assign":
        i = at - 1  # of the value's first character
        if data[i - 1] in b"\"'" and i - 1 >= after:
            i -= 1
        while i > after and data[i - 1] == 32:
            i -= 1
        i -= 1  # the sign
        while i > after and data[i - 1] == 32:
            i -= 1
        if i > after and data[i - 1] in b"\"'":
            i -= 1
        for length in (8, 6, 5, 7):
            if i - length >= after and rule.back.fullmatch(data, i - length, i):
                return i - length
        return None
    if rule.kind == "hex":
        return at - 32
    for m in rule.back.finditer(data, max(after, at - 64), at):
        if rule.shortest.fullmatch(data, m.start(), at):
            return m.start()
    return None


def spans(text: str | None, more: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    data = (text or "").encode()
    rules = _automaton(more)[0]
    out, at, points = [], 0, 0
    for k, start, end in find(data, more):
        points += len(data[at:start].decode("utf-8", "replace"))
        at = start
        out.append((rules[k].kind, points, points + len(data[start:end].decode("utf-8", "replace"))))
    return out


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), more: bool = True) -> DataFrame:
    """``keep`` and ``secrets``: an array of (kind, start, end), ends exclusive, by start and rule.

    One scan without a shuffle. Null and empty texts have none; repeated rows
    get equal values; other columns are not read.
    """
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def make() -> Callable:
        return lambda texts: [[[{"kind": k, "start": s, "end": e} for k, s, e in spans(t, more)] for t in texts]]

    return scan(docs, text, keep, [("secrets", kind)], make)


def redact(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mark: str = "<secret>") -> DataFrame:
    """``keep`` and the text with every secret replaced by ``mark``; null stays null."""

    def clean(value: str | None) -> str | None:
        if value is None:
            return None
        out, at = [], 0
        for _, start, end in spans(value):
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join([*out, value[at:]])

    return scan(docs, text, keep, [("text", T.StringType())], lambda: lambda texts: [[clean(t) for t in texts]])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; digests of the base rules' spans and all spans as text."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op6_secret_scan": op6_secret_scan}
SQL: dict[str, str] = {}
