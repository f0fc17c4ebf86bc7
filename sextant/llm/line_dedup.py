"""Fuzzy line dedup over a corpus.

Lines are normalised and signed with a SimHash of their 5-grams. To join them, each
line has SEEDS seeds, the smallest hashes of its SEED-grams: an edit touches the few
grams around it, in whatever word, so that copies keep some. Lines that share a seed
at places that as many edits as are allowed can bring together, and whose SimHashes
differ in FAR_WIDE bits at most, are candidates; edit similarity is verified on the
normalised text, and one occurrence of each connected group of lines stays in the
corpus.

Lines under MIDDLE characters and those of fewer than WORDY words (addresses, scripts
without spaces) meet in MinHash bands of 3-grams, under SHORT characters by pigeonhole
on pieces of their text, which loses no pair.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._edits import distance, within
from ._neardup import MIX_A, MIX_B, STEP, Same, components, mixed
from ._shared import col, cut, discard, fresh, lean, slices, table

SIMILARITY = 0.8
#: Rows of one bucket that a task compares at once; larger buckets go on in blocks of this size.
RUN = 2048
#: Rows whose pairs with those of a bucket a task holds at once.
ROWS = 64
#: Characters below which pieces find every pair, and below which 3-grams stand for words.
SHORT, MIDDLE = 25, 80
#: Lines of fewer distinct words, however long (addresses, scripts without spaces), meet by 3-grams as well.
WORDY = 12
#: Characters of a seed, and seeds of a line. Lines with one letter in ten changed at random share one with
#: probability 0.9, with one in twenty always but once in 100.
SEED, SEEDS = 14, 16
#: Bands of 3-grams and their MinHash values: two sets with Jaccard similarity 2/3 share a band with
#: probability 0.975; with 0.8, always but once in 10^5.
LINE_BANDS, LINE_ROWS = 40, 6
#: Candidates' SimHashes differ in no more bits: two standard deviations above what word sets with
#: Jaccard similarity 0.6 differ in.
FAR = 22
#: The same for the 128 bits of lines that meet by seeds: two standard deviations above what 5-grams of lines
#: with one letter in ten changed differ in.
FAR_WIDE = 50
#: Rows of a bucket whose pairs are all compared in one go with other buckets', and all go on if near. In larger
#: buckets the nearest ones go on first, and then the pairs that these do not connect.
FEW = 8
#: What goes with a row of a bucket: two numbers, the line's length and the seed's place. Lines that meet in bands have no
#: place, and counts of characters for ``more``. ANY stands for no place, and for numbers beyond it.
SKETCH = np.dtype([("sig", "<u8"), ("more", "<u8"), ("size", "<u2"), ("at", "<u2")])
ANY = 0xFFFF
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: The bits of a byte, one in each byte of a number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def normal(line: str) -> bytes:
    """Lower case, without ASCII punctuation, single spaces; a line of nothing else is itself."""
    words = line.lower().encode().translate(None, PUNCTUATION).split()
    return b" ".join(words or line.encode().split())


def simhash(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit signatures of the rows of hashes that begin at ``starts``; none may be empty.

    Eight bits are counted in the bytes of one number, 255 hashes at a time.
    """
    lengths = np.diff(np.append(starts, len(hashes)))
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    pieces_of = -(-lengths // 255)
    first = np.cumsum(pieces_of) - pieces_of
    within = np.arange(int(pieces_of.sum())) - np.repeat(first, pieces_of)
    counts = np.add.reduceat(spread, np.repeat(starts, pieces_of) + 255 * within, axis=0).view(np.uint8).reshape(-1, 64)
    if len(counts) > len(starts):
        counts = np.add.reduceat(counts, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts.astype(np.int32) > lengths[:, None], axis=1).copy().view(np.int64).ravel()


def rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` characters from each place on."""
    n = len(codes) - size + 1
    value = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        value = value * STEP + codes[k : k + n]
    return mixed(value)


def seeds(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sig, more, row, place, key): two SimHashes of each text's 5-grams, and its SEEDS smallest SEED-grams. No text is shorter."""
    codes = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in items], np.int64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - place
    value = rolled(codes, 5)[left[: len(codes) - 4] >= 5]
    first = starts - 4 * np.arange(len(items))
    sig, more = simhash(value, first), simhash(mixed(value ^ MIX_B), first)
    value = rolled(codes, SEED)
    row = np.repeat(np.arange(len(items)), lengths)[: len(value)]
    good = left[: len(value)] >= SEED
    # the smallest ones of long texts are among those under a bound, else all count
    under = good & (value.astype(np.float64) < 2.0**64 * np.minimum(1.0, 3.0 * SEEDS / lengths)[row])
    few = np.bincount(row[under], minlength=len(items)) < 2 * SEEDS
    at = np.flatnonzero(under | good & few[row])
    at = at[np.lexsort((at, value[at], row[at]))]
    at = at[np.append(True, (value[at][1:] != value[at][:-1]) | (row[at][1:] != row[at][:-1]))]
    ahead = np.searchsorted(row[at], np.arange(len(items)))
    at = at[np.arange(len(at)) - ahead[row[at]] < SEEDS]
    return sig, more, row[at], place[at], value[at]


def characters(item: str) -> int:
    """Counts of a text's characters in 16 classes, up to 15 each; an edit changes two by one at most."""
    codes = np.frombuffer(item.encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.minimum(np.bincount((mixed(codes) >> np.uint64(60)).astype(np.int64), minlength=16), 15)
    return sum(int(n) << 4 * i for i, n in enumerate(counts))


class Edits(Same):
    """Edit similarity 1 - distance / longer length of normalised lines, exactly.

    Bounds come first: lengths, the differing middles, and, of texts of GRAMS characters or more,
    counts of 4-grams, of which an edit changes 8 at most (4 old and 4 new ones).
    """

    GRAMS = 2048

    def __init__(self, least: float = SIMILARITY) -> None:
        self.least = least

    def prepare(self, item: str) -> tuple[str, np.ndarray | None, np.ndarray | None]:
        if len(item) < self.GRAMS:
            return item, None, None
        codes = np.frombuffer(item.encode("utf-32-le"), np.uint32).astype(np.uint64)
        grams = codes[:-3]
        for k in (1, 2, 3):
            grams = grams * np.uint64(0x110001) + codes[k : len(codes) - 3 + k]
        return item, *np.unique(grams, return_counts=True)

    def same(self, left: tuple, right: tuple) -> bool:
        found = self.settled(left, right)
        return found if isinstance(found, bool) else distance(*found) <= found[2]

    def all_same(self, left: list[tuple], right: list[tuple]) -> np.ndarray:
        """``same`` of many pairs; those that no bound settles are compared at once."""
        found = [self.settled(x, y) for x, y in zip(left, right, strict=True)]
        good = np.array([x is True for x in found], bool)
        rest = [i for i, x in enumerate(found) if not isinstance(x, bool)]
        if rest:
            good[rest] = within(*map(list, zip(*(found[i] for i in rest), strict=True)))
        return good

    def settled(self, left: tuple, right: tuple) -> bool | tuple[str, str, int]:
        """Whether two are the same, or else what is left of them and the edits that their distance may have."""
        (a, a_grams, a_counts), (b, b_grams, b_counts) = left, right
        longer = max(len(a), len(b))
        most = int(longer * (1 - self.least) + 1e-9)
        if abs(len(a) - len(b)) > most:
            return False
        i, stop = 0, min(len(a), len(b))
        for step in (4096, 64, 1):  # the common beginning
            while i + step <= stop and a[i : i + step] == b[i : i + step]:
                i += step
        j, stop = 0, stop - i
        for step in (4096, 64, 1):  # and end
            while j + step <= stop and a[len(a) - j - step : len(a) - j] == b[len(b) - j - step : len(b) - j]:
                j += step
        a, b = a[i : len(a) - j], b[i : len(b) - j]
        if max(len(a), len(b)) <= most:
            return True
        if a_grams is not None and b_grams is not None:
            at = np.minimum(np.searchsorted(b_grams, a_grams), len(b_grams) - 1)
            both = int(np.minimum(a_counts, b_counts[at])[b_grams[at] == a_grams].sum())
            if int(a_counts.sum()) + int(b_counts.sum()) - 2 * both > 8 * most:
                return False
        # words put in the place of others, as most near copies have them, bound the distance from above
        x, y = a.split(" "), b.split(" ")
        if len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y, strict=True) if u != v) <= most:
            return True
        return a, b, most


def handle(id_col: str, text: str) -> Column:
    """Tells documents apart also where ids repeat or are null; equal rows are one document."""
    return F.xxhash64(col(id_col), col(text))


def pieces(text: str, least: float = SIMILARITY, short: int = SHORT) -> set[tuple[int, int, str]]:
    """Keys (length, number, piece) of a short line; two with edit similarity ``least`` share one.

    The shorter of a pair, of length n, falls into one piece more than there are
    edits, so one stands in the longer near its own place (Li et al., Pass-Join).
    """
    longer, found = len(text), set()
    for n in range(int(longer * least - 1e-9) if longer else 0, longer + 1):
        edits, more = int(min(int(n / least + 1e-9), short - 1) * (1 - least) + 1e-9), longer - n
        if n < edits + 1 or not n:
            continue
        edges = [n * i // (edits + 1) for i in range(edits + 2)]
        for i in range(edits + 1):
            low, size = edges[i], edges[i + 1] - edges[i]
            first, last = max(0, low - i, low + more - (edits - i)), min(longer - size, low + i, low + more + edits - i)
            found |= {(n, i, text[at : at + size]) for at in range(first, last + 1)}
    return found


def minhash(values: np.ndarray, starts: np.ndarray, bands: int = LINE_BANDS, rows: int = LINE_ROWS) -> np.ndarray:
    """Band hashes (row, band) of the sets of hashes that begin at ``starts``; none may be empty."""
    out = np.zeros((len(starts), bands), np.uint64)
    values = mixed(values)
    for k in range(bands * rows):
        least = np.minimum.reduceat(mixed_once(values, k), starts)
        out[:, k // rows] = mixed(out[:, k // rows] * STEP + least)
    return out


def mixed_once(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th order of hashes."""
    x = (values ^ mixed(np.array([k + 1], np.uint64))) * MIX_A
    return (x ^ x >> np.uint64(32)) * MIX_B


def grams(item: str) -> np.ndarray:
    """Hashes of the distinct 3-grams of a text of three characters or more."""
    codes = np.frombuffer(item.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return mixed(np.unique((codes[:-2] * STEP + codes[1:-1]) * STEP + codes[2:]))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, doc, pos, node, more, size, sig, other, by_gram, counts, marks, item, pieces) of every line with a word.

    ``node`` and ``more`` are 128 bits of a digest of the normalised line, ``size`` its
    characters. The rest stands where a task first meets a line: SimHashes and the seeds,
    of lines that can be similar to those of MIDDLE characters or more; the SimHash of
    3-grams, ``counts`` of characters and the bands of those from SHORT to MIDDLE and of
    fewer than WORDY words; and ``pieces`` of the text ``item`` of short lines. ``marks`` are
    the seeds and bands: 48 bits of a bucket, then a seed's place, or ANY for bands.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(col(text).alias("text"), col(id_col).alias("id"), handle(id_col, text).alias("doc"))

    def listed(n: int, rows: np.ndarray, values: np.ndarray) -> pa.Array:
        """A list for each of ``n`` rows, null where it has none; ``rows`` may come in any order."""
        order = np.argsort(rows, kind="stable")
        counts = np.bincount(rows, minlength=n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(counts == 0, False))
        return pa.ListArray.from_arrays(offsets, pa.array(values[order], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in slices(batch, 0, 1 << 19):
                owner, pos, keys, sizes = [], [], [], []
                wide_rows, wide = [], []
                short_rows, short_keys, items = [], [], {}
                gram_rows, gram_values, counts = [], [], []
                for k, t in enumerate(part.column(0).to_pylist()):
                    raw = (t or "").split("\n")
                    for p, line in enumerate((t or "").lower().encode().translate(None, PUNCTUATION).split(b"\n")):
                        # as normal() has it for a single line
                        words = line.split() or raw[p].encode().split()
                        if not words:
                            continue
                        row, joint = len(owner), b" ".join(words)
                        key = blake2b(joint, digest_size=16).digest()
                        owner.append(k)
                        pos.append(p)
                        keys.append(key)
                        sizes.append(0)
                        if key in seen:
                            continue
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(key)
                        item = joint.decode("utf-8", "replace")
                        sizes[-1] = min(len(item), ANY)
                        if len(item) >= max(SEED, MIDDLE * least - 1):
                            wide_rows.append(row)
                            wide.append(item)
                        if max(3, SHORT * least - 1) <= len(item) and (len(item) < MIDDLE or len(set(words)) < WORDY):
                            gram_rows.append(row)
                            gram_values.append(grams(item))
                            counts.append(characters(item))
                        if len(item) < SHORT:
                            items[row] = item
                            for piece in pieces(item, least):
                                short_rows.append(row)
                                short_keys.append(int.from_bytes(blake2b(repr(piece).encode(), digest_size=8).digest(), "big", signed=True))
                n = len(owner)
                if not n:
                    continue
                none = np.zeros(0, np.uint64)
                sig, other, by_gram, hist = (np.zeros(n, np.int64) for _ in range(4))
                mark_rows, marks = [none.astype(np.int64)], [none]
                if wide:
                    at = np.array(wide_rows, np.int64)
                    sig[at], other[at], seed_rows, places, value = seeds(wide)
                    mark_rows.append(at[seed_rows])
                    marks.append(mixed(value) & ~np.uint64(ANY) | np.minimum(places, ANY - 1).astype(np.uint64))
                if gram_rows:
                    at = np.array(gram_rows, np.int64)
                    lengths = np.array([len(v) for v in gram_values])
                    flat, starts = np.concatenate(gram_values), np.cumsum(lengths) - lengths
                    by_gram[at], hist[at] = simhash(flat, starts), np.array(counts, np.uint64).view(np.int64)
                    mark_rows.append(np.repeat(at, LINE_BANDS))
                    marks.append(mixed(minhash(flat, starts) + np.arange(LINE_BANDS, dtype=np.uint64)).ravel() | np.uint64(ANY))
                digests = np.frombuffer(b"".join(keys), np.int64).reshape(n, 2)
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1).take(take), part.column(2).take(take), pa.array(pos, pa.int32()),
                        pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sizes, pa.int32()),
                        pa.array(sig), pa.array(other), pa.array(by_gram), pa.array(hist),
                        listed(n, np.concatenate(mark_rows), np.concatenate(marks).view(np.int64)),
                        pa.array([items.get(i) for i in range(n)], pa.string()), listed(n, np.array(short_rows, np.int64), np.array(short_keys, np.int64)),
                    ],
                    names=["id", "doc", "pos", "node", "more", "size", "sig", "other", "by_gram", "counts", "marks", "item", "pieces"],
                )

    return narrow.mapInArrow(lean(run), f"id {kind}, doc long, pos int, node long, more long, size int, sig long, other long, by_gram long, counts long, marks array<long>, item string, pieces array<long>")


def bucketed(rows: DataFrame) -> DataFrame:
    """(bucket, node, item): a row for each seed and band that another line has too, with a SKETCH; to discard after use.

    Most seeds stand in one line only: two numbers of each go through the first shuffle, which ends with its table, and
    sketches with the rest.
    """
    asked = rows.where("marks is not null")
    bucket = F.shiftright("mark", 16)
    met = asked.select(F.explode("marks").alias("mark"), "node").repartition(bucket).sortWithinPartitions(bucket, "node").mapInArrow(lean(_shared), "mark long, node long")
    met = cut(met, dictionary=False)
    sketches = asked.groupBy("node").agg(*[F.max(c).alias(c) for c in ("size", "sig", "other", "by_gram", "counts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, node, size, *sketch = (batch.column(i).to_numpy() for i in range(7))
            made = np.zeros(len(mark), SKETCH)
            made["size"], made["at"] = size, mark & ANY
            sig, other, by_gram, counts = (v.view(np.uint64) for v in sketch)
            made["sig"], made["more"] = (np.where(made["at"] < ANY, x, y) for x, y in ((sig, by_gram), (other, counts)))
            yield pa.RecordBatch.from_arrays([pa.array(mark >> 16), pa.array(node), packed(made)], names=["bucket", "node", "item"])

    joined = met.join(sketches, "node").select("mark", "node", "size", "sig", "other", "by_gram", "counts")
    out = joined.mapInArrow(lean(run), "bucket long, node long, item binary")
    out.scratch_path = met.scratch_path
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (mark, node) in the order of buckets and nodes, those beside a row of the same bucket and another node."""
    mark, node, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if batch.num_rows:
            mark, node = np.append(mark[-1:], batch.column(0).to_numpy()), np.append(node[-1:], batch.column(1).to_numpy())
            beside = (mark[1:] >> 16 == mark[:-1] >> 16) & (node[1:] != node[:-1])
            keep = np.append(met, beside[:-1]) | beside if len(beside) else beside
            met = bool(beside[-1]) if len(beside) else False  # of the last row, which waits for the next batch
            yield pa.RecordBatch.from_arrays([pa.array(mark[:-1][keep]), pa.array(node[:-1][keep])], names=["mark", "node"])
    yield pa.RecordBatch.from_arrays([pa.array(mark[-1:][[met] * len(mark[-1:])]), pa.array(node[-1:][[met] * len(node[-1:])])], names=["mark", "node"])


def packed(made: np.ndarray) -> pa.Array:
    """A binary value for each record."""
    offsets = np.arange(len(made) + 1, dtype=np.int32) * made.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(made.tobytes())])


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= bits


def _near_pairs(left: tuple, right: tuple | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the distinct SimHashes of ``left`` within ``bits``, or of ``left`` with those of ``right``, without those
    of one known component. A side is (SimHashes, components, whether known)."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    nodes, comps, known = left
    for k in range(len(nodes)):
        others, theirs, sure = (x[k + 1 :] for x in left) if right is None else right
        at = np.flatnonzero(_near(others, nodes[k], bits) & ~(known[k] & sure & (theirs == comps[k])))
        a.append(np.full(len(at), nodes[k]))
        b.append(others[at])
    return np.concatenate(a), np.concatenate(b)


def _known(node: np.ndarray, item: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct SimHashes, their components and whether they are known; ``item`` has them as text, if at all."""
    item = item or [None] * len(node)
    node, first = np.unique(node, return_index=True)
    return node, np.array([int(item[i] or 0) for i in first], np.int64), np.array([item[i] is not None for i in first], bool)


def _known_in_order(item: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not item:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    return np.array([int(x or 0) for x in item], np.int64), np.array([x is not None for x in item], bool)


class Buckets:
    """Compares the rows (bucket, node, item) of whole buckets; ``inside`` takes any number of
    them in order, ``across`` two parts of one. Both return edges. With ``first``, parts of a bucket meet its first part
    only, and rows that ``inside`` leaves in ``rest`` go on to a second step, as all those of buckets in parts do."""

    first = False
    rest: list

    def inside(self, bucket: np.ndarray, node: np.ndarray, item: list) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def across(self, left: tuple[np.ndarray, list], right: tuple[np.ndarray, list]) -> tuple[list, list]:
        raise NotImplementedError


class Near(Buckets):
    """SimHashes, which are the nodes, within ``bits``: all pairs but those within one component, which the items name."""

    def __init__(self, bits: int = FAR) -> None:
        self.bits = bits

    def inside(self, bucket, node, item):
        again = np.append(False, (bucket[1:] == bucket[:-1]) & (node[1:] == node[:-1]))
        item = [x for x, twice in zip(item, again, strict=True) if not twice] if item else item
        bucket, node = bucket[~again], node[~again]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(bucket)))
        small = np.repeat(sizes <= FEW, sizes)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        comp, known = _known_in_order(item, len(node))
        for d in range(1, FEW):
            at = np.flatnonzero((bucket[d:] == bucket[:-d]) & small[d:])
            if not len(at):
                break
            at = at[_near(node[at], node[at + d], self.bits) & ~(known[at] & known[at + d] & (comp[at] == comp[at + d]))]
            a.append(node[at])
            b.append(node[at + d])
        for k in np.flatnonzero(sizes > FEW):
            own = slice(starts[k], starts[k] + sizes[k])
            more = self.large(node[own], comp[own], known[own], int(bucket[starts[k]]))
            a.append(more[0])
            b.append(more[1])
        return np.concatenate(a), np.concatenate(b)

    def large(self, node, comp, known, bucket):
        return _near_pairs((node, comp, known), None, self.bits)

    def across(self, left, right):
        return _near_pairs(_known(*left), None if left is right else _known(*right), self.bits)


class Sketched(Buckets):
    """Lines, the items' sketches, that can have an edit similarity of ``least``: lengths and places of the common seed
    differ by no more than the edits, nor counts of characters (both exact), and SimHashes are near. All pairs but those
    within one component, which stands behind the sketch."""

    kind = np.dtype([*SKETCH.descr, ("comp", ">i8")])

    def __init__(self, least: float = SIMILARITY) -> None:
        self.least = least

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits that SimHashes differ in, and which pairs pass."""
        size, others, at, theirs = (v.astype(np.int32) for v in (x["size"], y["size"], x["at"], y["at"]))
        most = np.maximum(size, others) * (1 - self.least) + 1e-9
        placed = (at < ANY) & (theirs < ANY)
        apart = np.where(placed, np.abs(at - theirs) + np.abs(size - at - others + theirs), np.abs(size - others))
        bits = np.bitwise_count(x["sig"] ^ y["sig"]).astype(np.int32)
        more = np.bitwise_count(x["more"] ^ y["more"])
        seeded = (x["sig"] | x["more"] > 0) & placed
        good = ((apart <= most) | (size == ANY) | (others == ANY)) & np.where(placed, bits + more <= FAR_WIDE, bits <= FAR)
        if "comp" in x.dtype.names:
            good &= x["comp"] != y["comp"]
        return bits + np.where(seeded, more, 0), good

    def counted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of pairs without a place have counts of characters that so many edits can bring together."""
        good = (x["at"] < ANY) & (y["at"] < ANY) | (x["size"] == ANY)
        at = np.flatnonzero(~good)
        left, right = x["more"][at], y["more"][at]
        over, under = np.zeros(len(at), np.int16), np.zeros(len(at), np.int16)
        for shift in range(0, 64, 4):
            d = (left >> np.uint64(shift) & np.uint64(15)).astype(np.int16) - (right >> np.uint64(shift) & np.uint64(15)).astype(np.int16)
            over += np.maximum(d, 0)
            under += np.maximum(-d, 0)
        good[at] = np.maximum(over, under) <= np.maximum(x["size"][at], y["size"][at]) * (1 - self.least) + 1e-9
        return good

    def gated(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(low, bits, good) of ROWS rows of ``x``, from ``low`` on, and all of ``y``: which pairs pass. No more pairs are held."""
        for low in range(0, len(x), ROWS):
            bits, good = self.near(x[low : low + ROWS, None], y[None, :])
            i, j = np.nonzero(good)
            good[i, j] = self.counted(x[low + i], y[j])
            yield low, bits, good

    def inside(self, bucket, node, item):
        x = np.frombuffer(b"".join(item), self.kind)
        own = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])) if len(node) else np.zeros(0, bool)
        bucket, node, x = bucket[own], node[own], x[own]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(bucket)))
        small = np.repeat(sizes <= FEW, sizes)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, FEW):
            at = np.flatnonzero((bucket[d:] == bucket[:-d]) & small[d:])
            if not len(at):
                break
            at = at[self.near(x[at], x[at + d])[1]]
            at = at[self.counted(x[at], x[at + d])]
            a.append(node[at])
            b.append(node[at + d])
        for k in np.flatnonzero(sizes > FEW):
            one = slice(starts[k], starts[k] + sizes[k])
            more = self.large(node[one], x[one], int(bucket[starts[k]]))
            a.append(more[0])
            b.append(more[1])
        return np.concatenate(a), np.concatenate(b)

    def large(self, node, x, bucket):
        a, b = [], []
        for low, _, good in self.gated(x, x):
            i, j = np.nonzero(np.triu(good, low + 1))
            a.append(node[low + i])
            b.append(node[j])
        return np.concatenate(a), np.concatenate(b)

    def across(self, left, right):
        (n, x), (m, y) = ((v[0], np.frombuffer(b"".join(v[1]), self.kind)) for v in (left, right))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, _, good in self.gated(x, y):
            i, j = np.nonzero(good & (n[low : low + ROWS, None] != m[None, :]))
            a.append(n[low + i])
            b.append(m[j])
        return np.concatenate(a), np.concatenate(b)


class Nearest(Sketched):
    """The first step of two: of a bucket of more than FEW, each line with the nearest one and the nearest before it, 2 n
    pairs that connect n copies; all rows with a near one go on."""

    first, kind = True, SKETCH

    def large(self, node, x, bucket):
        some, a, b = self.nearest(node, x)
        self.rest.append((np.full(int(some.sum()), bucket), node[some], packed(x[some])))
        return a, b

    def nearest(self, node, x):
        """Which rows have a near one, and each of them with its nearest and the nearest before it."""
        some, place = np.zeros(len(node), bool), np.arange(len(node))
        a, b = [], []
        for low, bits, good in self.gated(x, x):
            mine = place[low : low + ROWS, None]
            for keep in (mine != place, mine > place):
                far = np.where(good & keep, bits, ANY)
                j = far.argmin(axis=1)  # the first of equal ones
                i = np.flatnonzero(far[np.arange(len(j)), j] < ANY)
                some[low + i] = True
                a.append(node[low + i])
                b.append(node[j[i]])
        return some, np.concatenate(a), np.concatenate(b)

    def across(self, left, right):
        node, first = np.unique(np.concatenate([left[0], right[0]]), return_index=True)
        x = np.frombuffer(b"".join([*left[1], *right[1]]), self.kind)[first]
        return self.nearest(node, x)[1:]


class Alike(Buckets):
    """Lines whose own texts, the items, have an edit similarity of ``least``."""

    def __init__(self, least: float) -> None:
        self.how = Edits(least)

    def inside(self, bucket, node, item):
        a, b = [], []
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
            if end - start > 1:
                own = (node[start:end], item[start:end])
                more = self.across(own, own)
                a += more[0]
                b += more[1]
        return np.array(a, np.int64), np.array(b, np.int64)

    def across(self, left, right):
        a, b = [], []
        mine, others = (dict(zip(x[0].tolist(), x[1], strict=True)) for x in (left, right))
        by_length = sorted(others, key=lambda n: len(others[n]))
        lengths = [len(others[n]) for n in by_length]
        for n, text in mine.items():
            for i in range(bisect_left(lengths, len(text) * self.how.least - 1e-9), bisect_right(lengths, len(text))):
                m = by_length[i]
                if n != m and self.how.same((text, None, None), (others[m], None, None)):
                    a.append(n)
                    b.append(m)
        for m, text in others.items() if left is not right else ():  # the longer one may stand on either side
            for n, other in mine.items():
                if len(text) > len(other) and self.how.same((text, None, None), (other, None, None)):
                    a.append(n)
                    b.append(m)
        return a, b


def bucket_links(rows: DataFrame, make: Callable[[], Buckets]) -> DataFrame:
    """Edges (a, b) between the rows (bucket, node, item) that meet in a bucket and pass."""
    return bucket_steps(rows, make)[0]


def bucket_steps(rows: DataFrame, make: Callable[[], Buckets]) -> tuple[DataFrame, DataFrame]:
    """These edges, and the rows (bucket, node, item) that go on to another step.

    One shuffle. Sorted buckets stream through a task; what a bucket has beyond
    RUN goes on by pairs of blocks, so that no task holds it.
    """
    kind = rows.schema["item"].dataType.simpleString()
    items_of = pa.binary() if kind == "binary" else pa.string()
    rows = rows.select("bucket", "node", "item").repartition("bucket").sortWithinPartitions("bucket", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, held, chunk, names = make(), None, 0, ["a", "b", "item", "chunk"]
        how.rest = []

        def edges(found) -> pa.RecordBatch:
            n = len(found[0])
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.nulls(n, items_of), pa.nulls(n, pa.int32())], names=names)

        def later(part: pa.Table, k: int) -> pa.RecordBatch:
            part = part.append_column("chunk", pa.array(np.full(part.num_rows, k, np.int32))).rename_columns(names)
            return part.combine_chunks().to_batches()[0]

        def compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
            items = part.column(2).to_pylist() if part.column(2).null_count < part.num_rows else []
            yield edges(how.inside(part.column(0).to_numpy(), part.column(1).to_numpy(), items))
            for bucket, node, item in how.rest:
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(node, pa.int64()), item, pa.array(np.full(len(node), -1, np.int32))], names=names)
            how.rest.clear()

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            bucket = held.column(0).to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))  # buckets are in order
            if last:
                done = 0
                if chunk:  # the rest of a large bucket
                    done = int(np.searchsorted(bucket, bucket[0], "right"))
                    yield later(held.slice(0, done), chunk)
                    chunk = 0
                if last > done:
                    yield from compare(held.slice(done, last - done))
                held = held.slice(last)
            while held.num_rows > RUN:
                yield later(held.slice(0, RUN), chunk)
                held, chunk = held.slice(RUN), chunk + 1
        if held is not None and held.num_rows:
            if chunk:
                yield later(held, chunk)
            else:
                yield from compare(held)

    found = cut(rows.mapInArrow(lean(run), f"a long, b long, item {kind}, chunk int"))
    going_on = found.where("chunk is not null").select(F.col("a").alias("bucket"), F.col("b").alias("node"), "item")
    large = found.where("chunk >= 0").select(F.col("a").alias("bucket"), F.col("b").alias("node"), "item", "chunk")
    sizes = large.groupBy("bucket").agg((F.max("chunk") + 1).alias("n"))
    last = F.when(F.col("chunk") > 0, 0).otherwise(F.col("n") - 1) if make().first else F.col("n") - 1
    paired = large.join(sizes, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    paired = paired.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "item")

    def pair(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        chunk, node, item = group.column("chunk").to_numpy(), group.column("node").to_numpy(), np.array(group.column("item").to_pylist(), object)
        left = node[chunk == i], item[chunk == i].tolist()
        a, b = make().across(left, left if i == j else (node[chunk == j], item[chunk == j].tolist()))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return found.where("chunk is null").select("a", "b").union(paired.groupBy("bucket", "i", "j").applyInArrow(pair, "a long, b long")), going_on


def linked(rows: DataFrame, lines: DataFrame, docs: DataFrame, id_col: str, text: str, least: float) -> DataFrame:
    """(node, comp) of the lines that chains of similar lines connect; ``rows`` as :func:`lines_of`
    has them, ``lines`` (node, more, n) the distinct ones.

    Candidates are all pairs of lines that share a bucket and whose sketches pass; no link among them is
    lost. In large buckets each line meets its nearest ones first. What these links do not connect is then compared
    pair by pair: copies of a line cost a few pairs each, and different lines with near sketches in one bucket as many
    as there are (quadratic in them).
    """
    ordered = lambda found: found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    buckets = bucketed(rows)
    met, going_on = bucket_steps(buckets, lambda: Nearest(least))
    discard(buckets)
    pairs = cut(ordered(met))
    items = _texts_of(pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), rows, lines, docs, id_col, text)
    short = bucket_links(rows.where("pieces is not null").select(F.explode("pieces").alias("bucket"), "node", "item"), lambda: Alike(least)).select("a", "b")
    joint = components(alike_pairs(pairs, items, least).union(short))
    comp = F.unhex(F.lpad(F.hex(F.coalesce("comp", "node")), 16, "0"))
    rest = bucket_links(going_on.join(joint, "node", "left").select("bucket", "node", F.concat("item", comp).alias("item")), lambda: Sketched(least))
    rest = cut(ordered(rest).join(pairs, ["a", "b"], "left_anti"))
    missing = cut(rest.select("a").union(rest.select("b")).toDF("node").distinct().join(items, "node", "left_anti"))
    texts = items if missing.isEmpty() else items.union(_texts_of(missing, rows, lines, docs, id_col, text))
    more = cut(alike_pairs(rest, texts, least))
    out = joint if more.isEmpty() else components(joint.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    for done in (pairs, items, rest, missing):
        discard(done)
    return out


def _texts_of(wanted: DataFrame, rows: DataFrame, lines: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, item): the normalised text of the nodes of ``wanted``, from one place of each."""
    place = rows.join(lines.select("node", "more"), ["node", "more"]).join(wanted, "node").groupBy("node").agg(F.min(F.struct("doc", "id", "pos")).alias("place"))
    return _items(docs, place, id_col, text)


def alike_pairs(pairs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose items (node, item) have an edit similarity of ``least``."""
    joined = pairs.join(items.toDF("a", "left"), "a").join(items.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = Edits(least)
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                made: dict = {}  # a line stands in many pairs of a part
                for t in (*left, *right):
                    if t not in made:
                        made[t] = how.prepare(t)
                good = how.all_same([made[t] for t in left], [made[t] for t in right])
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(lean(run), "a long, b long")


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, doc, removed): the documents that lose lines, with these lines' positions."""
    rows = cut(lines_of(docs, id_col, text, least), dictionary=False)
    # of two lines with the same first half of the digest, only the one with the smaller rest is joined with others
    lines = cut(rows.groupBy("node").agg(F.min("more").alias("more"), F.count("*").alias("n")))
    joint = linked(rows, lines, docs, id_col, text, least)
    # most lines stand once and are like no other: only the rest is ordered
    named = lines.select("node", "more", "n").join(joint, "node", "left").where("n > 1 or comp is not null")
    touched = named.select("node", "more", F.coalesce("comp", "node").alias("comp"))
    spots = cut(rows.select("id", "doc", "pos", "node", "more").join(touched, ["node", "more"]).select("id", "doc", "pos", "comp"))
    best = spots.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "doc", "pos")).alias("best"))
    stays = F.col("doc").eqNullSafe(F.col("best.doc")) & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("pos") == F.col("best.pos"))
    out = cut(spots.join(best, "comp").where(~stays).groupBy("id", "doc").agg(F.sort_array(F.collect_set("pos")).alias("removed")))
    for done in (rows, lines, spots):
        discard(done)
    return out


def _items(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, item): the normalised text of the wanted lines, each document's picked in one go."""
    asked = wanted.groupBy("place.id", "place.doc").agg(F.collect_list(F.struct("place.pos", "node")).alias("asked"))
    texts = docs.select(handle(id_col, text).alias("own"), col(id_col).alias("own_id"), col(text).alias("text"))
    # both sides grow with the corpus: the same join at every size
    joined = texts.join(asked.hint("shuffle_hash"), (F.col("own") == F.col("doc")) & F.col("own_id").eqNullSafe(F.col("id"))).select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                node, item = [], []
                for t, marks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    lines = (t or "").split("\n")
                    for m in marks:
                        node.append(m["node"])
                        item.append(normal(lines[m["pos"]]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(item, pa.string())], names=["node", "item"])

    return cut(joined.mapInArrow(lean(run), "node long, item string").dropDuplicates(["node"]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines``, ``n_removed`` (new names if these are taken).

    Of all lines of the corpus that a chain of edit similarities of ``least`` or
    more connects, the one of the smallest id, and there the first, stays; all
    others go, in the same document as in others. Lines without a word stay
    where they are. Rows with equal ids and texts are one document and get equal
    results; null texts stay null, null ids come last. Documents are never
    dropped: one that loses every line has an empty text. An empty table gives
    no rows.

    All similar pairs under SHORT characters are found, longer ones with the
    recall that the README gives.
    """
    names = docs.columns
    mine = [fresh(n, names) for n in ("gone_id", "gone_doc", "gone", "n_lines", "n_removed", "own")]
    gone_id, gone_doc, gone, n_lines, n_removed, own = mine
    lost = removals(docs, id_col, text, least).toDF(gone_id, gone_doc, gone).hint("shuffle_hash")
    joined = docs.withColumn(own, handle(id_col, text)).join(lost, (F.col(own) == F.col(gone_doc)) & col(id_col).eqNullSafe(F.col(gone_id)), "left")
    parts = F.split(col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    rebuilt = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    some = F.col(gone).isNotNull()
    out = [F.when(some, rebuilt).otherwise(col(c)).alias(c) if c == text else col(c) for c in names]
    lines = F.coalesce(F.regexp_count(col(text), F.lit(r"[^\n\x20\x09\x0B-\x0D][^\n]*")), F.lit(0)).cast("long")
    return joined.select(*out, lines.alias(n_lines), F.when(some, F.size(F.col(gone))).otherwise(0).cast("long").alias(n_removed))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many of them go, and a digest of what is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the lines that stay; those left without a word go."""
    out = dedup_lines(docs).where(col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else col(c) for c in docs.columns])


QUERIES = {"op1_line_dedup": op1_line_dedup}
SQL: dict[str, str] = {}
