"""BPE encoding and decoding by a prefix-sharing trie.

A byte-level BPE encoding has a local property: a row of tokens is what the
merges give for its bytes exactly when each two neighbours are what the merges
give for their joint bytes. So the encoding of a prefix is told by its *last
token* alone: it is the one vocabulary entry that ends the prefix and fits the
last token of what stands before it. The distinct words of a slice go into a
trie; a depth-first walk hands each node's last token down to its children, so
a prefix that many words share is encoded once; at a word's end the tokens are
read off the path.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import scan, table

#: Words and token pairs that a worker remembers between slices, and the length of the words.
REMEMBERED, REMEMBERED_CHARS = 120_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    found = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
    return found | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


class Vocabulary:
    """Tokens in order of rank: single bytes first, then one per merge."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        singles = sorted((t for t in vocab if len(t) == 1), key=vocab.__getitem__)
        self.bytes: list[bytes] = [raw(t) for t in singles]
        self.ids: list[int] = [vocab[t] for t in singles]
        self.left, self.right = list(range(len(singles))), list(range(len(singles)))
        self.index = {b: i for i, b in enumerate(self.bytes)}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, n = self.index[raw(a)], self.index[raw(b)], len(self.bytes)
            self.merged[x, y] = n
            self.left.append(x)
            self.right.append(y)
            self.bytes.append(self.bytes[x] + self.bytes[y])
            self.ids.append(vocab[a + b])
            self.index[self.bytes[n]] = n
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.lengths = [len(b) for b in self.bytes]
        self.fits: dict[int, bool] = {}
        self._suffixes()

    def fit(self, a: int, b: int) -> bool:
        """Whether the merges, given the bytes of ``a`` and ``b``, end at just these two.

        Undo the later of both tokens' merges again and again; the pair fails if
        tokens that meet at the seam would have merged earlier than that.
        """
        merged, left, right, x, y, before = self.merged, self.left, self.right, a, b, sys.maxsize
        while True:
            joint = merged.get((x, y))
            if joint is not None and joint < before:
                good = False
                break
            if x > y and right[x] != x:
                before, x = x, right[x]
            elif left[y] != y:
                before, y = y + 1, left[y]
            elif right[x] != x:
                before, x = x, right[x]
            else:
                good = True
                break
        if len(self.fits) > 3 * REMEMBERED:
            self.fits.clear()
        self.fits[a << 32 | b] = good
        return good

    def _suffixes(self) -> None:
        """For each prefix of a token (a state): its extensions by a byte, the state of
        its longest proper suffix, and the tokens that end it with their lengths."""
        self.next: list[dict[int, int]] = [{}]
        whole: dict[int, int] = {}
        for token, data in enumerate(self.bytes):
            state = 0
            for byte in data:
                if byte not in self.next[state]:
                    self.next[state][byte] = len(self.next)
                    self.next.append({})
                state = self.next[state][byte]
            whole[state] = token
        self.back = [0] * len(self.next)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        level = [0]
        while level:
            below = []
            for state in level:
                for byte, after in self.next[state].items():
                    if state:
                        self.back[after] = self.step(self.back[state], byte)
                    own = ((whole[after], len(self.bytes[whole[after]])),) if after in whole else ()
                    self.ends[after] = own + self.ends[self.back[after]]
                    below.append(after)
            level = below

    def step(self, state: int, byte: int) -> int:
        while (after := self.next[state].get(byte)) is None and state:
            state = self.back[state]
        return after or 0

    def _spelled(self, last: list[int], depth: int) -> bytes:
        found, packed, lengths = [], self.packed, self.lengths
        while depth:
            token = last[depth]
            found.append(packed[token])
            depth -= lengths[token]
        found.reverse()
        return b"".join(found)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each word's ids as packed little-endian unsigned 32-bit integers.

        The trie is held as its words in order with the length that each shares
        with the one before: a word's nodes from there on are its own, and going
        through the words visits the nodes depth-first. ``last`` and ``states``
        are what the nodes of the current path have handed down.
        """
        out: dict[str, bytes] = {}
        named = {word.encode(): word for word in words}
        trie = sorted(named)
        last = [0] * (max(map(len, trie), default=0) + 1)
        states = list(last)
        ends, following, step, fit, fits, spelled = self.ends, self.next, self.step, self.fit, self.fits, self._spelled
        for data, depth in zip(trie, shared_lengths(trie), strict=True):
            state = states[depth]
            for byte in data[depth:]:
                depth += 1
                state = states[depth] = following[state].get(byte) or step(state, byte)
                for token, length in ends[state]:  # the first that fits what stands before it
                    if length == depth:
                        break
                    before = last[depth - length]
                    good = fits.get(before << 32 | token)
                    if fit(before, token) if good is None else good:
                        break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
                last[depth] = token
            out[named[data]] = spelled(last, depth)
        return out


def shared_lengths(words: list[bytes], at_a_time: int = 20_000, longest: int = 256) -> list[int]:
    """The number of leading bytes that each of the sorted, distinct words shares with the one before."""
    found = [0] * min(1, len(words))
    for i in range(1, len(words), at_a_time):
        part = words[i - 1 : i + at_a_time]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        grid = np.array([w[:longest] for w in part], dtype=f"S{min(longest, lengths.max()) + 1}").view(np.uint8).reshape(len(part), -1)
        first = (grid[1:] != grid[:-1]).argmax(axis=1)
        same = (grid[1:] == grid[:-1]).all(axis=1)
        # words that only trailing zero bytes or what follows the grid tell apart look equal here
        shared = np.where(same, np.minimum(lengths[:-1], lengths[1:]), np.minimum(first, lengths[:-1])).tolist()
        for k in np.flatnonzero(same & (lengths[1:] > longest)).tolist():
            shared[k] = _shared(part[k], part[k + 1])
        found += shared
    return found


def _shared(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


#: The pre-tokeniser's pattern, as the vocabulary's published library has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Splitter:
    """Texts to words. The standard library's engine takes texts for which its
    classes agree with the pattern's; the others go to ``regex``."""

    def __init__(self) -> None:
        import regex

        self.odd = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl") or "\x1c" <= c <= "\x1f")
        self.fast = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        # White_Space by itself, as \s here has the separators 1C to 1F too
        self.exact = regex.compile(WORDS.replace(r"\s\p", r"\p{White_Space}\p").replace(r"\s+", r"\p{White_Space}+").replace(r"\S", r"\P{White_Space}")).findall

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if self.odd.isdisjoint(set(text)) else self.exact(text)


class Encoder:
    """Whole texts to packed ids, with the special tokens' strings recognised."""

    def __init__(self, path: str) -> None:
        self.vocabulary, self.words, self.known, self.older = Vocabulary(path), Splitter(), {}, {}
        specials = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.opening = {s[0] for s in specials}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        rows = []
        for text in texts:
            text = text or ""
            parts = self.special.split(text) if any(c in text for c in self.opening) else [text]
            rows.append([parts[i] if i % 2 else self.words(parts[i]) for i in range(len(parts))])
        known, older = self.known, self.older
        new = {w for row in rows for part in row[::2] for w in part}.difference(known)
        known.update((w, older[w]) for w in new & older.keys())
        made = self.vocabulary.encode_words(new.difference(older))
        known.update(made)
        specials = self.vocabulary.specials
        out = [
            b"".join(
                specials[part].to_bytes(4, "little") if i % 2 else b"".join(map(known.__getitem__, part))
                for i, part in enumerate(row)
            )
            for row in rows
        ]
        for word in made:
            if len(word) > REMEMBERED_CHARS:
                del known[word]
        if len(known) > REMEMBERED:  # those in use move back from the older half
            self.known, self.older = {}, known
        return out


class Decoder:
    def __init__(self, path: str) -> None:
        by_id = token_bytes(path)
        self.table = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]

    def __call__(self, rows: list[bytes | None]) -> list[str]:
        get, end = self.table.__getitem__, len(self.table)
        out = []
        for row in rows:
            ids = np.frombuffer(row or b"", dtype="<u4")
            out.append(b"".join(map(get, ids[ids < end].tolist())).decode("utf-8", "replace"))
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """Python workers serve many tasks: each loads a vocabulary once."""
    return Encoder(path)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, ids: bool = True) -> DataFrame:
    """``keep``, ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit integers).

    One scan without a shuffle. A null or empty text has no tokens. Repeated
    rows stay repeated; other columns of ``docs`` are neither read nor returned.
    Strings of special tokens are recognised, as the tokenizers library does.
    With ``ids=False`` only the lengths are returned.
    """
    path = vocabulary or default_vocabulary()

    def make():
        encoder = _encoder(path)

        def run(texts):
            packed = encoder(texts)
            lengths = [len(x) // 4 for x in packed]
            return [lengths, packed] if ids else [lengths]

        return run

    return scan(docs, text, keep, [("n_tokens", T.LongType()), *[("ids", T.BinaryType())] * ids], make)


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``text``, the text of packed ids; null ids give the empty text, unknown ids nothing.

    Bytes that are no UTF-8 are replaced, as the tokenizers library does; ids
    from :func:`encode` always give back their text.
    """
    path = vocabulary or default_vocabulary()
    return scan(encoded, ids, keep, [("text", T.StringType())], lambda: lambda rows: [_decoder(path)(rows)])


def round_trip(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``keep``, ``n_tokens``, ``ids`` and ``text``, what these ids decode to: :func:`encode` and :func:`decode` in one scan.

    A slice of texts is encoded, its packed ids are decoded again from their
    bytes alone, and one worker holds both tables. Rows are treated as there; an
    empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    def run(texts: list[str | None]) -> list:
        packed = _encoder(path)(texts)
        return [[len(x) // 4 for x in packed], packed, _decoder(path)(packed)]

    return scan(docs, text, keep, [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("text", T.StringType())], lambda: run)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, then decoded from its ids; digests of both."""
    out = round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, with its source; null texts have none, an empty table gives no rows."""
    return encode(docs, keep=("doc_id", "source"))


QUERIES = {"op2_bpe_round_trip": op2_bpe_round_trip}
SQL: dict[str, str] = {}
