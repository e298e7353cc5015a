"""MPEG audio in a column: payloads stored in frames, and what a file's frames say.

Payload bytes lie in the ancillary data of silent Layer III frames of 48 kHz, so
that a frame lasts 24 ms exactly. The last frame takes the lowest bit rate that
fits, which makes the stream one of variable bit rate, with a seek table in
front. Tags carry a checksum of their own and the payload's length.

Reading takes any file: it skips tags, finds the frames again after damage,
verifies checksums, reads Xing, Info and VBRI tables, and gives the exact duration
and the offset of every frame.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from larkbeam.llm.batches import map_batches
from larkbeam.sources.files import rewritten

# Fixed values of the standard: kilobits a second by index from 1 on, and samples a second.
_V1_L1 = (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
_V1_L2 = (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
_V1_L3 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_V2_L1 = (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
_V2_L23 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}

_SIDE = 17  # bytes of side information in a frame of one channel
_AHEAD = 4 + 2 + _SIDE
_UNIT = 64


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    rate: int
    channels: int
    samples: int
    size: int


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """What the four bytes of a frame header say, or None if they are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bits in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    if version == 1:
        kilobits = (_V1_L1, _V1_L2, _V1_L3)[layer - 1][bits - 1]
    else:
        kilobits = (_V2_L1 if layer == 1 else _V2_L23)[bits - 1]
    hertz, padding = _RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    if layer == 1:
        size = (12_000 * kilobits // hertz + padding) * 4
    else:
        size = samples // 8 * 1000 * kilobits // hertz + padding
    return Header(version, layer, not four[1] & 1, hertz, 1 if four[3] >> 6 == 3 else 2, samples, size)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of frames: polynomial 0x8005, all bits set at first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _side(h: Header) -> int:
    return ((17, 32) if h.version == 1 else (9, 17))[h.channels - 1]


def _sevens(n: int, places: int) -> bytes:
    return bytes(n >> 7 * i & 0x7F for i in reversed(range(places)))


def _of_sevens(data: bytes) -> int:
    n = 0
    for byte in data:
        n = n << 7 | byte & 0x7F
    return n


def _frame(index: int, body: bytes) -> bytes:
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(_SIDE)
    size = header(head).size
    made = head + struct.pack(">H", crc16(head[2:] + side)) + side + body
    return made + bytes(size - len(made))


_ROOM = [144 * k * 1000 // 48000 - _AHEAD for k in _V1_L3]


def _tag(frames: dict[str, bytes]) -> bytes:
    body = b"".join(k.encode() + _sevens(len(v) + 1, 4) + b"\0\0" + b"\3" + v for k, v in frames.items())
    extended = _sevens(12, 4) + b"\1\x20\5" + _sevens(binascii.crc32(body), 5)
    return b"ID3\4\0\x40" + _sevens(len(extended) + len(body), 4) + extended + body


def store(payload: bytes) -> bytes:
    """A file whose frames hold the payload."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index = next((i for i, room in enumerate(_ROOM) if room >= left), len(_ROOM) - 1)
        frames.append(_frame(index + 1, payload[at : at + _ROOM[index]]))
        at += _ROOM[index]
    total = sum(map(len, frames))
    toc, done, n = [], 0, 0
    for percent in range(100):
        while n < len(frames) * percent // 100:
            done += len(frames[n])
            n += 1
        toc.append(256 * done // total)
    table = b"Xing" + struct.pack(">III", 0xF, len(frames), total) + bytes(toc) + struct.pack(">I", 0)
    tag = _tag({"TLEN": str(24 * len(frames)).encode(), "TXXX": b"payload\0" + str(len(payload)).encode()})
    return tag + _frame(5, table) + b"".join(frames)


@dataclass
class Audio:
    """What a file holds. ``duration`` in seconds is ``samples / rate`` exactly."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    skipped: int = 0
    checked: int = 0
    damaged: int = 0
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    seek: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    tag_intact: bool | None = None
    parts: list[bytes] = field(default_factory=list)

    def payload(self) -> bytes:
        whole = b"".join(self.parts)
        length = self.tags.get("TXXX", "").removeprefix("payload\0")
        return whole[: int(length)] if length.isdecimal() else whole


def _read_tag(data: bytes, out: Audio) -> int:
    """Reads a tag in front; gives where it ends."""
    if len(data) < 10 or data[:3] != b"ID3":
        return 0
    end = min(len(data), 10 + _of_sevens(data[6:10]) + 10 * bool(data[5] & 0x10))
    at, major = 10, data[3]
    if data[5] & 0x40 and end > at + 6:
        size = _of_sevens(data[10:14]) if major == 4 else struct.unpack(">I", data[10:14])[0] + 4
        if major == 4 and data[15] & 0x20 and size >= 12:
            flags = 16 + (1 if data[15] & 0x40 else 0)
            stated = _of_sevens(data[flags + 1 : flags + 6])
            out.tag_intact = stated == binascii.crc32(data[10 + size : end])
        at += size
    while at + 10 <= end and data[at : at + 1].isalnum():
        name = data[at : at + 4].decode("latin-1")
        size = _of_sevens(data[at + 4 : at + 8]) if major == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        value = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and value:
            kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3]
            out.tags[name] = value[1:].decode(kind, "replace").rstrip("\0")
        at += 10 + max(size, 0)
    return end


def _tables(frame: bytes, h: Header, out: Audio) -> bool:
    """Whether the first frame holds a table in place of sound; reads it."""
    at = 4 + 2 * h.protected + _side(h)
    name = frame[at : at + 4] if h.layer == 3 else b""
    if name in (b"Xing", b"Info") and len(frame) >= at + 8:
        out.table, flags, at = name.decode(), struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8
        for bit, size in ((1, 4), (2, 4), (4, 100)):
            if flags & bit and len(frame) >= at + size:
                value = frame[at : at + size]
                if bit == 4:
                    out.seek = value
                elif bit == 1:
                    out.table_frames = struct.unpack(">I", value)[0]
                else:
                    out.table_bytes = struct.unpack(">I", value)[0]
                at += size
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, _ = struct.unpack(">HHHH", frame[54:62])
        out.seek = frame[62 : 62 + entries * width]
        return True
    return False


def _ends_of_sound(data: bytes, start: int) -> list[int]:
    """Where the sound may end: without what looks like tags at the end, and with it."""
    ends = [len(data)]
    if ends[0] - 128 >= start and data[ends[0] - 128 : ends[0] - 125] == b"TAG":
        ends.insert(0, ends[0] - 128)
    for end in ends.copy():
        if end - 32 >= start and data[end - 32 : end - 24] == b"APETAGEX":
            size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], data[end - 9]
            ends.append(end - size - 32 * bool(flags & 0x80))
    return sorted({e for e in ends if e >= start})


def _runs_to(data: bytes, at: int, end: int) -> bool:
    """Whether frames of one kind follow one another from ``at`` to ``end`` exactly."""
    kind = None
    while at < end:
        h = header(data[at : at + 4])
        if not h or kind not in (None, (h.version, h.layer, h.rate)):
            return False
        kind = (h.version, h.layer, h.rate)
        at += h.size
    return at == end


def read(data: bytes) -> Audio:
    """What the file holds. An empty file, or one without frames, holds nothing.

    What looks like a tag at the end is sound if frames run through it to its end.
    """
    out = Audio()
    at, kind = _read_tag(data, out), None
    end, *later = _ends_of_sound(data, at)
    while at <= end:
        h = header(data[at : at + 4])
        fits = h and (kind is None or (h.version, h.layer, h.rate) == kind)
        if fits and later and at + h.size > end and (reached := [e for e in later if _runs_to(data, at, e)]):
            end = reached[0]
            later = [e for e in later if e > end]
        if at + 4 > end:
            break
        fits = fits and at + h.size <= end
        if fits and (kind is None or out.skipped) and at + h.size + 4 <= end:
            # a place that only looks like a header is seldom followed by another
            after = header(data[at + h.size : at + h.size + 4])
            fits = after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        if not fits:
            found = data.find(b"\xff", at + 1, end)
            step = (found if found >= 0 else end) - at
            out.skipped += step
            at += step
            continue
        first, kind = kind is None, (h.version, h.layer, h.rate)
        frame = data[at : at + h.size]
        if h.protected and h.layer == 3:
            out.checked += 1
            covered = frame[2:4] + frame[6 : 6 + _side(h)]
            out.damaged += struct.unpack(">H", frame[4:6])[0] != crc16(covered)
        if not (first and _tables(frame, h, out)):
            out.offsets.append(at)
            out.samples += h.samples
            ahead = 4 + 2 * h.protected + _side(h)
            if h.layer == 3 and not any(frame[ahead - _side(h) : ahead]):
                out.parts.append(frame[ahead:])
        out.rate = h.rate
        at += h.size
    out.skipped += max(0, end - at)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's length in bytes, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % _UNIT if raw else _UNIT)


def stored(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``n_bytes`` and ``media``, the file that holds each whole text, beside ``keep``.

    A null text counts as empty. Equal texts give equal files. Other columns are ignored.
    """

    def work() -> Callable[[list], list[tuple]]:
        return lambda texts: [(n, store(p)) for n, p in map(payload_of, texts)]

    return map_batches(df, keep, text, work, "n_bytes long, media binary")


def features(audio: Audio) -> str:
    """The facts about a file that its bytes alone decide, as JSON."""
    offsets = b"".join(struct.pack(">Q", x) for x in audio.offsets)
    return json.dumps({
        "frames": len(audio.offsets), "samples": audio.samples, "rate": audio.rate,
        "table": audio.table, "table_frames": audio.table_frames, "table_bytes": audio.table_bytes,
        "checked": audio.checked, "damaged": audio.damaged, "skipped": audio.skipped,
        "tag_intact": audio.tag_intact, "offsets_crc32": binascii.crc32(offsets),
    })


def seek_table(df: DataFrame, keep: list[str], media: str) -> DataFrame:
    """Exact duration and the offset of every frame, of each file. Null counts as an empty file."""

    def work() -> Callable[[list], list[tuple]]:
        def rows(files: list) -> Iterator[tuple]:
            for a in map(read, (f or b"" for f in files)):
                yield a.samples, a.rate, a.skipped, a.damaged, a.offsets

        return lambda files: list(rows(files))

    added = "samples long, rate int, skipped long, damaged int, offsets array<long>"
    return map_batches(df, keep, media, work, added)


def round_trip(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Stores every text as a file in a table, reads the table, and digests what was read.

    ``samples`` by ``rate`` is the exact duration in seconds, ``offsets`` where each frame begins. Null and empty texts are 64 zero bytes. Repeated rows give equal rows, and an
    empty table an empty one.
    """
    table = rewritten(stored(df, keep, text), name="media")

    def work() -> Callable[[list], list[tuple]]:
        def digest(media: bytes) -> tuple:
            audio = read(media)
            payload = audio.payload()
            return (
                len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-_UNIT:]),
                len(media), hashlib.sha256(media).hexdigest(), features(audio), audio.samples, audio.rate, audio.offsets,
            )

        return lambda files: [digest(f) for f in files]

    added = (
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "samples long, rate int, offsets array<long>"
    )
    return map_batches(table, [*keep, "n_bytes"], "media", work, added)
