"""Main text of HTML pages: markup regions and differences between pages with neighbouring URLs of one host."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ._shared import col, cut, discard, fresh, scan, table
from ._sorted import in_order

#: What a line's place in the markup says of it.
OPEN, BOILERPLATE, MAIN, LINKS = 0, 1, 2, 3
#: Two pages with so large a share of lines in common are copies, and tell nothing of their template.
COPY_SHARE = 0.8

# Elements of the HTML standard, by what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg canvas object video audio select".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = {"nav": BOILERPLATE, "header": BOILERPLATE, "footer": BOILERPLATE, "aside": BOILERPLATE, "form": BOILERPLATE, "dialog": BOILERPLATE, "menu": BOILERPLATE, "button": BOILERPLATE, "fieldset": BOILERPLATE, "head": BOILERPLATE, "article": MAIN, "main": MAIN}
ROLES = {"navigation": BOILERPLATE, "banner": BOILERPLATE, "contentinfo": BOILERPLATE, "complementary": BOILERPLATE, "search": BOILERPLATE, "form": BOILERPLATE, "dialog": BOILERPLATE, "alertdialog": BOILERPLATE, "alert": BOILERPLATE, "menu": BOILERPLATE, "menubar": BOILERPLATE, "main": MAIN, "article": MAIN}
# Parts of class names and ids that say what a region is.
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comments comment disqus "
    "respond replies widget pagination pager skip copyright legal".split()
)
KEEPS, NEGATES = frozenset("content main article post entry body story".split()), frozenset("no has with without not".split())
#: Regions in which an article is no main text: comments and teasers are often marked up as articles.
NESTS = frozenset("aside sidebar comments comment disqus respond replies related recommended widget footer".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _region(tag: str, attributes: str) -> tuple[int, frozenset]:
    """What an element says of its text, and the names that say so."""
    kind, names = REGIONS.get(tag, OPEN), frozenset([tag])
    if not attributes:
        return kind, names
    parts: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "role":
            kind = ROLES.get(value.strip().lower(), kind)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            kind = BOILERPLATE
        elif name in ("class", "id"):
            for word in value.lower().split():
                parts.update(takewhile(lambda part: part not in NEGATES, re.split(r"[-_:]+", word)))
    if tag in ("html", "body"):
        return OPEN, names
    if parts & NESTS and kind != BOILERPLATE:  # also a comment or teaser marked up as an article
        return BOILERPLATE, names | parts & NESTS
    if kind == OPEN and parts & NAMES and not parts & KEEPS:
        return BOILERPLATE, names | parts & NAMES
    return kind, names


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The page's lines in order, and what each one's place says of it.

    A line is the text between two block-level tags or line breaks, with
    character references decoded and white space turned into single spaces;
    empty ones are left out. Comments, scripts, styles, form controls and the
    head are no text. Elements may be left open or closed twice: an end tag
    closes the nearest open element of its name, a block ends a paragraph, and
    an unfinished tag at the end of a cut page is no text.
    """
    lines: list[str] = []
    marks: list[int] = []
    #: Open elements: tag, kind in force, names that gave it; and how many of each tag.
    stack: list[tuple[str, int, frozenset]] = []
    still_open: Counter[str] = Counter()
    pieces: list[str] = []
    linked = unlinked = False
    links = headings = at = 0

    def leave(keep: int) -> None:
        while len(stack) > keep:
            still_open[stack.pop()[0]] -= 1

    def leave_out(gone: Callable[[tuple], bool]) -> None:
        kept = [s for s in stack if not gone(s)]
        leave(0)
        stack.extend(kept)
        still_open.update(s[0] for s in kept)

    def flush() -> None:
        nonlocal linked, unlinked
        line = " ".join("".join(pieces).split())
        pieces.clear()
        if line:
            kind, names = stack[-1][1:] if stack else (OPEN, frozenset())
            if kind == BOILERPLATE and headings and "header" in names and any(s[1] == MAIN for s in stack):
                kind = MAIN  # the title of an article stands in its own header
            lines.append(line)
            marks.append(LINKS if kind == OPEN and linked and not unlinked else kind)
        linked = unlinked = False

    def say(text: str) -> None:
        nonlocal linked, unlinked
        if text:
            pieces.append(html.unescape(text) if "&" in text else text)
            if not text.isspace():
                linked, unlinked = linked or links > 0, unlinked or links == 0

    while found := TOKEN.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        tag = found.group(2) or found.group(5)
        if not tag:
            continue
        tag = tag.lower()
        ending = (found.group(1) or found.group(4)) == "/"
        attributes = found.group(3) or found.group(6) or ""
        if tag == "a":
            links = max(links + (-1 if ending else 1), 0)
        if tag in INLINE:
            if ending:
                if stack and stack[-1][0] == tag:
                    flush()
                    leave(len(stack) - 1)
            elif attributes:
                kind, names = _region(tag, attributes)
                if kind == BOILERPLATE:
                    flush()
                    stack.append((tag, kind, names))
                    still_open[tag] += 1
            continue
        flush()
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag in VOID:
            continue
        if tag in HEADINGS:
            headings = 0 if ending else 1
        if ending:
            if still_open[tag]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                links = links if tag in ("p", "li") else 0
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE):  # a block ends a paragraph and what it left open
            leave(len(stack) - 1)
        if tag == "body":
            leave_out(lambda s: s[0] != "html")
        if tag == "li" and stack and stack[-1][0] == "li":
            leave(len(stack) - 1)
        kind, names = _region(tag, attributes)
        around = [s for s in stack if s[1] == BOILERPLATE] if stack and stack[-1][1] == BOILERPLATE else []
        if kind == MAIN and around:
            if any(s[2] & NESTS for s in around):
                kind, names = BOILERPLATE, stack[-1][2]
            else:  # no article stands in a menu or an advert: those were left open
                leave_out(lambda s: s[1] == BOILERPLATE)
        elif stack and (kind == OPEN or around):
            kind, names = stack[-1][1:]
        stack.append((tag, kind, names))
        still_open[tag] += 1
    say(page[at:])
    flush()
    return lines, marks


def _digests(lines: Sequence[str]) -> bytes:
    return np.fromiter((xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines)).tobytes()


# -- differences between pages --------------------------------------------------------------------------


def _prefixes(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``, a word of bits a row of ``a``."""
    where: dict[int, int] = {}
    for i, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hits = row & where.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[bool]:
    """Which entries of ``a`` stand in a longest common subsequence with ``b``.

    Equal ends are taken first, then halves of ``a`` are aligned with the place
    in ``b`` that keeps most lines, so memory stays linear in the lines.
    """
    out = [False] * len(a)
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out[a0] = True
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out[a1] = True
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            out[a0] = a[a0] in b[b0:b1]
            continue
        middle = (a0 + a1) // 2
        before = _prefixes(a[a0:middle], b[b0:b1])
        after = _prefixes(a[middle:a1][::-1], b[b0:b1][::-1])
        cut_at = b0 + int(np.argmax(before + after[::-1]))
        work += [(a0, middle, b0, cut_at), (middle, a1, cut_at, b1)]
    return out


def _segments(a: str, b: str) -> int:
    """How many path segments two paths begin with alike."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_with(path: str, lines: Sequence[int], others: Sequence[tuple[str, Sequence[int]]]) -> list[bool]:
    """Which lines a page shares with the nearest of ``others`` (path, lines) that is not its copy.

    Nearest is the one with most path segments in common, the earlier one among equals.
    """
    for _, other in sorted(others, key=lambda o: -_segments(path, o[0])):
        common = common_lines(lines, other)
        if sum(common) < COPY_SHARE * max(len(lines), len(other)):
            return common
    return [False] * len(lines)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, version, shared) of each version of a page beside its neighbours in the order of ``in_order``."""
    #: The last two rows: part, whether own, host, path, version, lines.
    one: tuple | None = None
    two: tuple | None = None
    schema = pa.schema([("host", pa.string()), ("version", pa.binary()), ("shared", pa.list_(pa.bool_()))])
    done: list[tuple] = []

    def meets(x: tuple | None, y: tuple) -> bool:
        return x is not None and x[0] == y[0] and x[2] == y[2]

    def settle(before: tuple | None, now: tuple | None, after: tuple | None) -> None:
        if now is None or not now[1]:
            return
        others = [(x[3], x[5]) for x in (before, after) if x is not None and meets(x, now)]
        done.append((now[2], now[4], shared_with(now[3], now[5], others)))

    def out() -> pa.RecordBatch:
        made = [pa.array([d[k] for d in done], schema.field(k).type) for k in range(3)]
        done.clear()
        return pa.RecordBatch.from_arrays(made, schema=schema)

    for batch in batches:
        for part, side, host, path, version, lines in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            row = (part, side == 0, host, path, version, np.frombuffer(lines, np.uint64).tolist())
            settle(one, two, row)
            one, two = two, row
        if done:
            yield out()
    settle(one, two, None)
    if done:
        yield out()


def _address(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both null where it names no host."""
    shape = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)"
    host = F.lower(F.regexp_extract(url, shape, 1))
    path = F.regexp_replace(F.regexp_extract(url, shape, 2), r"/+$", "")
    return F.when(host != "", host), F.when(host != "", path)


def shared_lines(versions: DataFrame) -> DataFrame:
    """(host, version, shared) for rows (host, path, version, lines): lines in common with the nearest page of the host.

    ``version`` identifies a page's lines (8-byte digests); pages of a host with
    the same lines are one version, which stands where its first path does. So
    copies are no neighbours of each other. Rows go by host and path in ranges,
    and a host of any size is spread over them.
    """
    first = versions.groupBy("host", "version").agg(F.min(F.struct("path", "lines")).alias("x")).select("host", "x.path", "version", "x.lines")
    ordered, parts = in_order(first, ["host", "path", "version"])
    out = cut(ordered.mapInArrow(_compared, "host string, version binary, shared array<boolean>"))
    discard(parts)
    return out


def main_text(df: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """``df`` without ``page``, with ``text``, ``n_chars``, ``n_lines`` and ``n_shared``.

    Pages are cut into lines, the lines of each are aligned with those of the
    page of the nearest path on its host by longest common subsequence, and
    shared lines are deleted, as are lines in regions that the markup names as
    menus, headers, footers, sidebars, notices, adverts, forms or comments. Where
    the page marks its article, its lines are the text, shared or not: an article
    may quote what its neighbour quotes. Elsewhere lines of links alone are menus.

    A null or empty page has the empty text. A page without a host, or alone on
    it, has nothing shared. Equal pages of a host have equal results; repeated
    rows are repeated. Columns of ``df`` may have any name; where one is called
    as a new column, the new one gets an underscore more. An empty table gives
    an empty one.
    """
    keep = [c for c in df.columns if c != page]
    host, path = _address(col(url))
    text = T.ArrayType(T.StringType())

    def versions():
        def read(pages: list) -> tuple:
            found = [_digests(lines_of(p or "")[0]) for p in pages]
            return [xxh3_128_digest(x) for x in found], found

        return read

    def texts():
        def read(pages: list) -> tuple:
            both = [lines_of(p or "") for p in pages]
            return [a for a, _ in both], [[int(m) for m in b] for _, b in both], [xxh3_128_digest(_digests(a)) for a, _ in both]

        return read

    placed = df.select(col(page).alias("page"), host.alias("host"), path.alias("path"))
    digests = scan(placed.where("host is not null"), "page", ["host", "path"], [("version", T.BinaryType()), ("lines", T.BinaryType())], versions)
    shared = shared_lines(digests)
    named = df.select(col(page).alias("page"), host.alias("host"), *[col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    cells = [f"c{i}" for i in range(len(keep))]
    cut_up = scan(named, "page", ["host", *cells], [("lines", text), ("marks", T.ArrayType(T.ByteType())), ("version", T.BinaryType())], texts)
    both = cut_up.join(shared, ["host", "version"], "left")
    declared = F.exists("marks", lambda m: m == MAIN)
    away = lambda i: F.coalesce(F.get(F.col("shared"), i), F.lit(False))
    kept = F.filter("lines", lambda x, i: F.when(declared, F.get(F.col("marks"), i) == MAIN).otherwise((F.get(F.col("marks"), i) == OPEN) & ~away(i)))
    taken: list[str] = list(keep)
    names = []
    for name in ("text", "n_chars", "n_lines", "n_shared"):
        names.append(fresh(name, taken))
        taken.append(names[-1])
    made = both.select(*cells, F.array_join(kept, "\n").alias("x"), F.size("lines").cast("long").alias("n"), F.size(F.filter(F.coalesce("shared", F.array().cast("array<boolean>")), lambda s: s)).cast("long").alias("s"))
    return made.select(*cells, "x", F.length("x").cast("long").alias("l"), "n", "s").toDF(*keep, *names)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op11_html_extraction": op11_html_extraction}
#: Alignment by longest common subsequence has no SQL form; the tests compare with brute force.
SQL: dict[str, str] = {}
