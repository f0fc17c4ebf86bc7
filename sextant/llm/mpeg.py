"""Media columns: MPEG audio streams in a binary column.

``store`` lays any bytes into a valid MPEG-1 Layer III stream: a version 2 tag,
a frame with the variable-bitrate table, then mono frames whose audio part is
silent, with the bytes in the ancillary part that players skip. ``parse`` reads
any stream: it skips tags, resynchronises on frame headers that agree with the
ones that follow, reads the variable-bitrate table, verifies the checksums, and
returns exact durations and frame seek offsets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import scan, table

#: Payloads are filled up with spaces to a positive multiple of this.
UNIT = 192
#: Fixed values of the format: bitrates in kbit/s and sampling rates by header index, for MPEG-1 and MPEG-2.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: MPEG-1 Layer III at 48 kHz, mono, with checksums: (bitrate index, frame bytes, payload bytes).
WIDE, NARROW = (14, 960, 768), (6, 240, 192)
SIDE = 17
HEAD = 4 + 2 + SIDE


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 8005, begun with FFFF, high bit first."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def _head(bitrate_index: int) -> bytes:
    """Header, checksum and silent side information of one of our frames."""
    header = bytes([0xFF, 0xFA, bitrate_index << 4 | 1 << 2, 0xC0])
    return header + crc16(header[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


_HEADS = {kind: _head(kind[0]) for kind in (WIDE, NARROW)}


#: A version 1 tag without entries. It ends every stored stream, so no payload can be taken for one.
LAST_TAG = b"TAG" + bytes(124) + b"\xff"


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def pad(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def store(payload: bytes) -> bytes:
    """A stream with ``payload``, whose length is a positive multiple of UNIT."""
    units = len(payload) // UNIT
    runs = [(WIDE, units // 4), (NARROW, units % 4)]
    parts, sizes, at = [], [], 0
    for kind, n in runs:
        if n:
            _, size, room = kind
            frames = np.zeros((n, size), np.uint8)
            frames[:, :HEAD] = np.frombuffer(_HEADS[kind], np.uint8)
            frames[:, HEAD : HEAD + room] = np.frombuffer(payload, np.uint8, n * room, at).reshape(n, room)
            at += n * room
            parts.append(frames.tobytes())
            sizes.append(np.full(n, size))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    first = bytearray(NARROW[1])
    total, frames_n = NARROW[1] + int(offsets[-1]), len(offsets) - 1  # as players count: without tags
    points = (NARROW[1] + offsets[np.arange(100) * frames_n // 100]) * 256 // total
    xing = b"Xing" + (7).to_bytes(4, "big") + frames_n.to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(np.minimum(points, 255).astype(np.uint8))
    first[:HEAD] = _HEADS[NARROW]
    first[HEAD : HEAD + len(xing)] = xing
    text = b"\x03" + f"{len(payload)} bytes".encode()
    frame = b"TIT2" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _synchsafe(len(frame)) + frame + bytes(first) + b"".join(parts) + LAST_TAG


def header(data: bytes, at: int) -> tuple[int, int, int, int, bool, int] | None:
    """(version, layer, sampling rate, frame bytes, checksum follows, channels) or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer = {3: 1, 2: 2, 0: 3}.get(b >> 3 & 3), {3: 1, 2: 2, 1: 3}.get(b >> 1 & 3)
    rate_index, bit_index = c >> 2 & 3, c >> 4
    if version is None or layer is None or rate_index == 3 or bit_index in (0, 15):
        return None
    rate = RATES[rate_index] >> version - 1
    bits = BITRATES[min(version, 2), layer][bit_index] * 1000
    padding = c >> 1 & 1
    if layer == 1:
        size = (12 * bits // rate + padding) * 4
    else:
        size = (72 if layer == 3 and version > 1 else 144) * bits // rate + padding
    return version, layer, rate, size, not b & 1, 1 if d >> 6 == 3 else 2


def samples(version: int, layer: int) -> int:
    return 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152


class Stream:
    """What a parse finds.

    ``frames``: (offset, bytes) of each audio frame; ``n_samples`` over them and
    ``rate`` give the exact duration; ``table``: frames, bytes and seek points
    that the variable-bitrate frame declares, or None; ``checked`` and
    ``failed`` checksums; ``skipped`` bytes outside tags and frames.
    """

    def __init__(self, data: bytes) -> None:
        self.frames: list[tuple[int, int]] = []
        self.n_samples = self.rate = self.checked = self.failed = self.skipped = self.tags = 0
        self.table: tuple[int, int, bytes] | None = None
        at, end = 0, len(data)
        while data[at : at + 3] == b"ID3" and at + 10 <= end:
            self.tags += 1
            at += 10 + sum((data[at + 6 + i] & 0x7F) << 7 * (3 - i) for i in range(4)) + 10 * (data[at + 5] >> 4 & 1)
        if end - 128 >= at and data[end - 128 : end - 125] == b"TAG":
            self.tags += 1
            end -= 128
        known: dict[bytes, bool] = {}
        agreed = None  # version, layer and rate of the last frame
        while at < end:
            found = header(data, at)
            if found and found[3] >= 4 and at + found[3] <= end and (agreed == found[:3] or self._follows(data, at + found[3], end, found[:3])):
                agreed = found[:3]
                self._frame(data, at, found, known)
                at += found[3]
                continue
            agreed = None
            after = data.find(b"\xff", at + 1, end)
            after = end if after < 0 else after
            self.skipped += after - at
            at = after

    @staticmethod
    def _follows(data: bytes, at: int, end: int, like: tuple) -> bool:
        """After a loss of sync a header counts only if the stream ends or agrees after its frame."""
        if at == end:
            return True
        found = header(data, at)
        return found is not None and found[:3] == like

    def _frame(self, data: bytes, at: int, found: tuple, known: dict[bytes, bool]) -> None:
        version, layer, rate, size, checked, channels = found
        side = 0
        if layer == 3:
            side = (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)
        body = at + 4 + 2 * checked + side
        if not self.frames and self.table is None and layer == 3 and data[body : body + 4] in (b"Xing", b"Info"):
            flags = int.from_bytes(data[body + 4 : body + 8], "big")
            numbers, place = [], body + 8
            for bit in (1, 2):
                numbers.append(int.from_bytes(data[place : place + 4], "big") if flags & bit else 0)
                place += 4 * bool(flags & bit)
            self.table = (*numbers, data[place : place + 100] if flags & 4 else b"")
            return
        if checked and layer == 3:
            covered = data[at + 2 : at + 6 + side]  # header, sum and side information
            if covered not in known:
                known[covered] = crc16(covered[:2] + covered[4:]) == int.from_bytes(covered[2:4], "big")
            self.checked += 1
            self.failed += not known[covered]
        self.frames.append((at, size))
        self.n_samples += samples(version, layer)
        self.rate = rate


def read_back(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream that :func:`store` made; frames of other sizes hold none."""
    view = memoryview(data)
    room = {kind[1]: kind[2] for kind in (WIDE, NARROW)}
    return b"".join(view[at + HEAD : at + HEAD + room.get(size, 0)] for at, size in stream.frames)


FEATURES = [
    ("n_frames", T.LongType()), ("n_samples", T.LongType()), ("rate", T.LongType()), ("n_tags", T.LongType()),
    ("checksums", T.LongType()), ("bad_checksums", T.LongType()), ("skipped_bytes", T.LongType()),
    ("declared_frames", T.LongType()), ("declared_bytes", T.LongType()), ("offsets", T.ArrayType(T.LongType())), ("payload", T.BinaryType()),
]


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_bytes`` of the text in UTF-8, and ``media``, the stream that holds it padded.

    A null text counts as empty; an empty text becomes one unit of spaces. Equal
    texts have equal streams, repeated rows stay, an empty table gives an empty
    one, texts of any length are stored whole, and columns of ``docs`` may have
    any name.
    """

    def make() -> Callable:
        def run(texts: list[str | None]) -> list:
            data = [(t or "").encode() for t in texts]
            return [[len(x) for x in data], [store(pad(x)) for x in data]]

        return run

    return scan(docs, text, keep, [("n_bytes", T.LongType()), ("media", T.BinaryType())], make)


def parse(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",), payload: bool = True) -> DataFrame:
    """``keep`` and FEATURES of each stream; a null or empty stream has no frames.

    ``offsets`` has the byte offset of each frame, so frame k starts at sample
    k * 1152 (MPEG-1 Layer III). ``payload`` is null with ``payload=False``, and
    empty for streams from elsewhere. Repeated rows, empty tables, long streams
    and clashing names are as in :func:`encode`.
    """

    def one(data: bytes | None) -> tuple:
        data = data or b""
        s = Stream(data)
        frames, size, _ = s.table or (None, None, b"")
        return len(s.frames), s.n_samples, s.rate, s.tags, s.checked, s.failed, s.skipped, frames, size, [at for at, _ in s.frames], read_back(data, s) if payload else None

    return scan(media, column, keep, FEATURES, lambda: lambda rows: list(zip(*map(one, rows), strict=True)) if rows else [[] for _ in FEATURES])


def op8_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a stream and parsed from it again; digests of both and the features."""
    media = encode(table(spark, sf_dir, "documents"))
    read = parse(media, keep=("doc_id", "n_bytes", "media"))
    length = F.octet_length("payload")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("rate="), "rate"), F.concat(F.lit("frames="), "n_frames"),
        F.concat(F.lit("declared="), "declared_frames", F.lit("/"), "declared_bytes"),
        F.concat(F.lit("checksums="), "checksums", F.lit("-"), "bad_checksums"), F.concat(F.lit("tags="), "n_tags"), F.concat(F.lit("skipped="), "skipped_bytes"),
        F.concat(F.lit("seek="), F.md5(F.array_join(F.transform("offsets", lambda x: x.cast("string")), ","))),
    )
    return read.select(
        "doc_id", "n_bytes", length.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 15, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
        (F.col("n_samples") / F.col("rate")).alias("seconds"),
    )


QUERIES = {"op8_mpeg_media": op8_mpeg_media}
SQL: dict[str, str] = {}
