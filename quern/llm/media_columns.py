"""Media columns [operator 10]: MPEG transport streams.

A payload is cut into elementary packets with timestamps, each starting at a
transport packet of its own; every RANDOM_ACCESS_EVERY-th starts with a clock
reference and the random-access flag. The demultiplexer trusts only the bytes:
it follows the program association table to the program map table to the
stream, checks section checksums, sync bytes and continuity counters,
reassembles the elementary packets, and reports timestamps and the packet
numbers of the random-access points.

Null text is empty text, and empty text is one unit of blanks, so every row has
media. Repeated rows and equal texts give equal media. Rows are independent:
there is no shuffle, and extra columns are ignored. A stream that breaks any
check raises ValueError instead of giving wrong bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import by_batch, table, texts_of

UNIT = 192
PACKET, BODY = 188, 184
PAT_PID, PMT_PID, MEDIA_PID = 0x0000, 0x1000, 0x0100
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 1, 0x06, 0xBD
ELEMENTARY_BYTES = 64 * UNIT
RANDOM_ACCESS_EVERY = 8
TICKS = 3600
#: Bytes of text whose streams are held at a time.
PART_BYTES = 1 << 20


class Stream(NamedTuple):
    payload: bytes
    packets: int
    timestamps: list[int]
    random_access: list[int]


@lru_cache(64)
def section_checksum(data: bytes) -> int:
    """CRC-32 of program sections: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_checksum(head))


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter) + b"\0" + section).ljust(PACKET, b"\xff")


PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
PMT = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_DATA, 0xE000 | MEDIA_PID, 0xF000))


def _stamp(ticks: int) -> bytes:
    """33 bits of time in five bytes with marker bits."""
    return bytes((0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1))


def _elementary(data: bytes, ticks: int, random_access: bool, counter: int) -> tuple[bytes, int]:
    """One elementary packet as transport packets, and the next continuity counter."""
    unit = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, len(data) + 8, 0x80, 0x80, 5) + _stamp(ticks) + data
    field = b"\x50" + struct.pack(">IH", ticks >> 1 & 0xFFFFFFFF, (ticks & 1) << 15 | 0x7E00) if random_access else b""
    out = []
    room = BODY - (len(field) + 1 if field else 0)
    fresh = True
    while fresh or unit:
        if not fresh and len(unit) >= BODY:
            count = len(unit) // BODY
            rows = np.empty((count, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = 0x47, MEDIA_PID >> 8, MEDIA_PID & 0xFF
            rows[:, 3] = 0x10 | (counter + np.arange(count) & 15)
            rows[:, 4:] = np.frombuffer(unit, np.uint8, count * BODY).reshape(count, BODY)
            out.append(rows.tobytes())
            unit, counter = unit[count * BODY :], counter + count
            continue
        piece, unit = unit[:room], unit[room:]
        spare = BODY - len(piece)
        if spare:
            body = (field or b"\0").ljust(spare - 1, b"\xff") if spare > 1 else b""
            extra = bytes((spare - 1,)) + body
        else:
            extra = b""
        out.append(struct.pack(">BHB", 0x47, (0x4000 if fresh else 0) | MEDIA_PID, (0x30 if spare else 0x10) | counter & 15) + extra + piece)
        counter, fresh, field, room = counter + 1, False, b"", BODY
    return b"".join(out), counter & 15


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload, tables repeated before each random-access point."""
    out, counter, tables = [], 0, 0
    for k, start in enumerate(range(0, max(len(payload), 1), ELEMENTARY_BYTES)):
        random_access = k % RANDOM_ACCESS_EVERY == 0
        if random_access:
            out += [_table_packet(PAT_PID, tables & 15, PAT), _table_packet(PMT_PID, tables & 15, PMT)]
            tables += 1
        data, counter = _elementary(payload[start : start + ELEMENTARY_BYTES], k * TICKS, random_access, counter)
        out.append(data)
    return b"".join(out)


def _read_section(packet: bytes, table_id: int) -> bytes:
    at = 5 + packet[4]
    length = struct.unpack_from(">H", packet, at + 1)[0] & 0x0FFF
    section = packet[at : at + 3 + length]
    if section[0] != table_id or section_checksum(section[:-4]) != struct.unpack(">I", section[-4:])[0]:
        raise ValueError(f"bad section for table {table_id}")
    return section[8:-4]


@lru_cache(1024)
def _association(packet: bytes) -> int:
    body = _read_section(packet, 0x00)
    programs = [struct.unpack_from(">HH", body, i) for i in range(0, len(body), 4)]
    return next(pid & 0x1FFF for number, pid in programs if number)


@lru_cache(1024)
def _stream_pid(packet: bytes) -> int:
    body = _read_section(packet, 0x02)
    at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0x0FFF)
    return struct.unpack_from(">H", body, at + 1)[0] & 0x1FFF


def _unbroken(counters: np.ndarray, pid: int) -> None:
    if len(counters) > 1 and ((counters[1:] - counters[:-1]) % 16 != 1).any():
        raise ValueError(f"continuity counter broken on pid {pid}")


def demux(media: bytes) -> Stream:
    """What the stream's own bytes say; ValueError where a check fails."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of transport packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("sync byte missing")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    counters = rows[:, 3].astype(np.int16) & 15
    tables = np.flatnonzero(pids == PAT_PID)
    if not len(tables):
        raise ValueError("no program association table")
    _unbroken(counters[tables], PAT_PID)
    map_pid = {_association(rows[i].tobytes()) for i in tables}
    maps = np.flatnonzero(pids == next(iter(map_pid)))
    if len(map_pid) != 1 or not len(maps):
        raise ValueError("no single program map table")
    _unbroken(counters[maps], next(iter(map_pid)))
    stream = {_stream_pid(rows[i].tobytes()) for i in maps}
    if len(stream) != 1:
        raise ValueError("no single stream")
    own = np.flatnonzero(pids == stream.pop())
    own_rows = rows[own]
    _unbroken(counters[own], MEDIA_PID)
    extended = (own_rows[:, 3] & 0x20) != 0
    start = np.where(extended, 5 + own_rows[:, 4].astype(np.int32), 4)
    flags = np.where(extended & (own_rows[:, 4] > 0), own_rows[:, 5], 0)
    body = own_rows[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    firsts = np.flatnonzero(own_rows[:, 1] & 0x40)
    borders = [*(ends[firsts] - (PACKET - start[firsts])).tolist(), len(body)]
    parts, stamps = [], []
    for a, b in zip(borders, borders[1:], strict=False):
        prefix, length, head = body[a : a + 3], *struct.unpack_from(">H", body, a + 4), body[a + 8]
        if prefix != b"\0\0\1" or length != b - a - 6:
            raise ValueError("elementary packet is damaged")
        t = body[a + 9 : a + 14]
        stamps.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        parts.append(body[a + 9 + head : b])
    return Stream(b"".join(parts), len(rows), stamps, own[firsts][(flags[firsts] & 0x40) != 0].tolist())


def padded(text: bytes) -> bytes:
    """text with blanks up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT)


def stored(texts: list[bytes]) -> Iterator[tuple[bytes, Stream]]:
    """Each text's stream, and what reading that stream gives back."""
    for text in texts:
        media = mux(padded(text))
        yield media, demux(media)


COLUMNS = "doc_id bigint, n_bytes bigint, media binary, payload binary, packets bigint, timestamps array<bigint>, random_access array<bigint>"


def _by_part(docs: DataFrame, schema: str, row: Callable[[bytes, bytes, Stream], tuple]) -> DataFrame:
    """doc_id and row(text, media, stream) of each document; a few texts at a time are streams."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}

    def step(batch: pa.RecordBatch):
        first, texts = 0, texts_of(batch.column(1))
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < PART_BYTES):
                size += len(texts[last])
                last += 1
            part = texts[first:last]
            rows = list(zip(*(row(text, media, stream) for text, (media, stream) in zip(part, stored(part), strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).cast(pa.int64()), *(pa.array(c, arrow[k]) for c, k in zip(rows, kinds[1:], strict=True))], list(names))
            first = last

    return by_batch(docs.select("doc_id", "text"), step, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Per document its stream, and what reading that stream gives back."""
    return _by_part(docs, COLUMNS, lambda text, media, stream: (len(text), media, *stream))


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digests(text: bytes, media: bytes, stream: Stream) -> tuple:
    payload, stamps, points = stream.payload, stream.timestamps, stream.random_access
    feature = f"ts:{stream.packets};pes:{len(stamps)};pts:{stamps[0]}-{stamps[-1]};rap:{len(points)}@{points[-1]}"
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of what media_columns() returns, taken where it is made, so that streams don't travel."""
    return _by_part(docs, DIGESTS, _digests)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
