"""Payloads as MPEG transport streams: program tables, elementary packets with timestamps, random-access points."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, sub_batches

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, DATA_PID = 0, 0x1000, 0x0100
#: private PES data (stream type), private stream 1 (stream id)
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT, TICKS, RANDOM_EVERY = 32768, 3600, 8  # payload bytes of a PES packet, 90 kHz ticks between them, units from one random-access point to the next


@cache
def _crc_table() -> tuple[int, ...]:
    def entry(i: int) -> int:
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        return c & 0xFFFFFFFF

    return tuple(map(entry, range(256)))


def section_crc(data: bytes) -> int:
    crc, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A program-table section with its length, current version 0 and CRC."""
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (5 + len(body) + 4), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


@cache
def _tables() -> np.ndarray:
    """PAT and PMT packets with continuity counter 0."""
    pat = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = _section(2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
    out = np.full((2, PACKET), 0xFF, dtype=np.uint8)
    for row, (pid, section) in zip(out, ((PAT_PID, pat), (PMT_PID, pmt)), strict=True):
        data = struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section
        row[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _pcr(base: int) -> bytes:
    return struct.pack(">IH", base >> 1 & 0xFFFFFFFF, (base & 1) << 15 | 0x7E00)


def _unit_packets(unit: bytes, t: int, random: bool, counter: int) -> np.ndarray:
    """Transport packets of one PES packet."""
    data = b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, 8 + len(unit), 0x84, 0x80, 5) + _pts(t) + unit
    first = BODY - 8 * random
    n = 1 + max(0, -(-(len(data) - first) // BODY))
    rows = np.full((n, PACKET), 0xFF, dtype=np.uint8)
    rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    rows[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
    rows[0, 1] |= 0x40
    field = bytes([7, 0x50]) + _pcr(t) if random else b""
    source = np.frombuffer(data, dtype=np.uint8)
    fill = first + (n - 1) * BODY - len(data)  # stuffing of the last packet
    whole = n if not fill else n - 1
    if field:
        rows[0, 3] |= 0x20
        rows[0, 4:12] = np.frombuffer(field, dtype=np.uint8)
    if whole:
        rows[0, PACKET - first :] = source[:first]
        rows[1:whole, 4:] = source[first : first + (whole - 1) * BODY].reshape(-1, BODY)
    if fill:
        rest = source[first + (n - 2) * BODY :] if n > 1 else source
        start = 4 + len(field) if n == 1 else 4
        rows[-1, 3] |= 0x20
        rows[-1, 4] = fill + len(field) * (n == 1) - 1
        if n == 1 and field:
            rows[-1, 5] = 0x50
        elif fill > 1:
            rows[-1, start + 1] = 0
        rows[-1, PACKET - len(rest) :] = rest
    return rows


def mux(payload: bytes) -> bytes:
    """A transport stream of one program whose only elementary stream carries ``payload``; equal payloads, equal streams."""
    parts, counter = [], 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        random = k % RANDOM_EVERY == 0
        if random:
            tables = _tables().copy()
            tables[:, 3] |= k // RANDOM_EVERY & 15
            parts.append(tables)
        parts.append(_unit_packets(payload[at : at + UNIT], k * TICKS, random, counter))
        counter += len(parts[-1])
    return np.concatenate(parts).tobytes()


class StreamError(ValueError):
    """A transport stream that breaks the format."""


def _payload_packets(rows: np.ndarray, what: str) -> np.ndarray:
    """Positions of the packets with payload, each once: the format lets a packet be sent twice, and packets that only
    carry an adaptation field stand outside the counting. Any other step of the continuity counter is an error."""
    own = np.flatnonzero(rows[:, 3] & 0x10)
    if not len(own):
        return own
    counters = rows[own, 3].astype(np.int16) & 15
    step = np.diff(counters) % 16
    twice = np.concatenate([[False], (step == 0) & (rows[own[1:]] == rows[own[:-1]]).all(axis=1)])
    if (step[~twice[1:]] != 1).any() or (twice[1:] & twice[:-1]).any():
        raise StreamError(f"continuity counter of {what} jumps: packets are lost or out of order")
    return own[~twice]


def _payload_starts(rows: np.ndarray) -> np.ndarray:
    begin = np.where(rows[:, 3] & 0x20, 5 + rows[:, 4].astype(np.int64), 4)
    if (begin > PACKET).any():
        raise StreamError("an adaptation field goes beyond its packet")
    return begin


def _checked(section: bytes, table_id: int) -> bytes:
    """A section's body, from its last fixed field to its CRC."""
    if section[0] != table_id:
        raise StreamError("another table in its place")
    if section_crc(section):
        raise StreamError("a program table's CRC differs")
    return section[8:-4]


def read_tables(rows: np.ndarray, table_id: int, what: str) -> bytes:
    """The body of a PID's table. Every section is read, over as many packets as it takes, and all must be the same."""
    if not len(rows):
        raise StreamError("a program table is missing")
    rows = rows[_payload_packets(rows, what)]
    begin, first = _payload_starts(rows), (rows[:, 1] & 0x40) > 0
    if not len(rows) or not first[0]:
        raise StreamError("a program table doesn't start in its packet")
    heads = np.flatnonzero(first)
    sections = set()
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(rows)], strict=True):
        data = b"".join(rows[i, begin[i] :].tobytes() for i in range(a, b))
        data = data[1 + data[0] :] if data else b""
        size = 3 + (struct.unpack_from(">H", data, 1)[0] & 0x0FFF) if len(data) > 2 else 0
        if not 12 <= size <= len(data):
            raise StreamError("a program table isn't whole")
        sections.add(data[:size])
    if len(bodies := {_checked(x, table_id) for x in sections}) != 1:
        raise StreamError("program tables differ")
    return bodies.pop()


def first_program(pat: bytes) -> int:
    """PID of the first program's map; program 0 names the network instead."""
    for at in range(0, len(pat) - 3, 4):
        program, pid = struct.unpack_from(">HH", pat, at)
        if program:
            return pid & 0x1FFF
    raise StreamError("no program")


def private_stream(pmt: bytes) -> int:
    """PID of the first elementary stream with private data; descriptors of program and streams are passed over."""
    at = 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0x0FFF)
    while at + 5 <= len(pmt):
        kind, pid, more = struct.unpack_from(">BHH", pmt, at)
        if kind == STREAM_TYPE:
            return pid & 0x1FFF
        at += 5 + (more & 0x0FFF)
    raise StreamError("no program with private data")


def demux(stream: bytes) -> tuple[bytes, list[tuple[int, int, int, bool]]]:
    """The elementary stream, and (timestamp, packet, byte of the payload, random access) of each PES packet.

    The elementary PID is found by way of PAT and PMT. Sync bytes, CRCs of all tables, continuity, PES lengths and timestamps
    are checked. Other programs and streams, packets sent twice and packets without payload are passed over.
    """
    if not stream or len(stream) % PACKET:
        raise StreamError("not whole transport packets")
    rows = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise StreamError("sync byte lost")
    pid = (rows[:, 1].astype(np.uint16) & 0x1F) << 8 | rows[:, 2]
    pmt_pid = first_program(read_tables(rows[pid == PAT_PID], 0, "PID 0"))
    es_pid = private_stream(read_tables(rows[pid == pmt_pid], 2, f"PID {pmt_pid}"))
    where = np.flatnonzero(pid == es_pid)
    where = where[_payload_packets(rows[where], "the elementary stream")]
    own = rows[where]
    begin = _payload_starts(own)
    adapted = (own[:, 3] & 0x20) > 0
    starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(starts) or starts[0]:
        raise StreamError("the stream doesn't start with a PES packet")
    sizes = PACKET - begin
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    edges = np.append(np.cumsum(sizes)[starts] - sizes[starts], len(data)).tolist()
    random = (adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0))[starts].tolist()
    units, index, done, last = [], [], 0, -1
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if data[a : a + 4] != b"\x00\x00\x01" + bytes([STREAM_ID]) or struct.unpack_from(">H", data, a + 4)[0] != b - a - 6:
            raise StreamError("a PES packet isn't whole")
        p = data[a + 9 : a + 14]
        t = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
        if t <= last:
            raise StreamError("timestamps don't rise")
        unit = data[a + 9 + data[a + 8] : b]
        index.append((t, int(where[starts[k]]), done, random[k]))
        units.append(unit)
        done, last = done + len(unit), t
    return b"".join(units), index


def pad(data: bytes, to: int = 64) -> bytes:
    return data + bytes(max(to, -(-len(data) // to) * to) - len(data))


INDEX = "array<struct<pts:long,packet:int,offset:long,random_access:boolean>>"


def store_media(docs: DataFrame) -> tuple[DataFrame, str]:
    """Mux every text (null: empty; UTF-8, zero-padded to a positive multiple of 64) and write the streams as a table.

    Columns: doc_id, n_bytes, media, points (timestamps with random-access points). Returns the table reread, and its path.
    A null doc_id is carried, repeated rows are stored as often, an empty table gives an empty one; other columns are ignored.
    """
    import pyarrow as pa

    point = pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int32()), ("offset", pa.int64()), ("random_access", pa.bool_())]))

    def run(batches):
        for batch in sub_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                media = mux(pad(raw))
                rows.append((len(raw), media, [dict(zip(("pts", "packet", "offset", "random_access"), x, strict=True)) for x in demux(media)[1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], point)], ["doc_id", "n_bytes", "media", "points"])

    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = source.mapInArrow(run, f"doc_id long, n_bytes long, media binary, points {INDEX}")
    path = fresh_path(spark, "media")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path), path


def media_features(media: DataFrame) -> DataFrame:
    """Demux stored streams and describe them; the stored points must be those found."""
    import pyarrow as pa

    def run(batches):
        for batch in sub_batches(batches, column=2):
            rows = []
            for n, stream, points in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                payload, index = demux(stream)
                if [tuple(x.values()) for x in points] != index:
                    raise StreamError("the stored index differs from the stream")
                jumps = np.abs(np.diff(np.frombuffer(payload, dtype=np.uint8).astype(np.int16)))
                feature = f"packets={len(stream) // PACKET};units={len(index)};random={sum(x[3] for x in index)};last_pts={index[-1][0]};mean_step={int(jumps.sum()) * 1000 // len(jumps)}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
