"""MPEG transport streams as a media column.

``mux`` stores bytes losslessly: units of the payload become packetised
elementary packets with time stamps, cut into 188-byte transport packets behind
program tables. ``demux`` reads such a stream back: it parses the program
tables, checks every continuity counter, reassembles the elementary packets and
lists time stamps with their random-access points.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
STREAM_PRIVATE, STREAM_ID = 0x06, 0xBD
UNIT = 192 * 16
TICKS = 3600
ACCESS_EVERY = 4
BLOCK = 192
SLICE = 256


def _crc_table() -> list[int]:
    """CRC-32/MPEG-2 remainders of all bytes (polynomial 0x04C11DB7, high bit first)."""
    table = []
    for byte in range(256):
        rest = byte << 24
        for _ in range(8):
            rest = ((rest << 1) ^ (0x04C11DB7 if rest & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(rest)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=1024)
def section_crc(section: bytes) -> int:
    """CRC of a section; 0 over a section with its own CRC."""
    rest = 0xFFFFFFFF
    for byte in section:
        rest = ((rest << 8) & 0xFFFFFFFF) ^ _CRC[(rest >> 24) ^ byte]
    return rest


@lru_cache(maxsize=64)
def table_section(table_id: int, number: int, body: bytes) -> bytes:
    """A long-form section with its CRC."""
    length = 5 + len(body) + 4
    section = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return section + section_crc(section).to_bytes(4, "big")


def _packet(pid: int, start: bool, counter: int, field_: bytes, payload: bytes) -> bytes:
    """One packet; an adaptation field takes ``field_`` and stuffing as the payload leaves room."""
    room = PACKET - 4 - len(payload)
    head = bytes([SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if room else 0x10) | counter & 15])
    if not room:
        return head + payload
    content = (field_ or b"\x00")[: room - 1]
    return head + bytes([room - 1]) + content + b"\xff" * (room - 1 - len(content)) + payload


def _clock(ticks: int) -> bytes:
    """A program clock reference of ``ticks`` at 90 kHz."""
    return (((ticks & 0x1FFFFFFFF) << 15) | 0x7E00).to_bytes(6, "big")


def _stamp(ticks: int) -> bytes:
    """A presentation time stamp."""
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """Store ``payload`` as a transport stream of one program with one data stream."""
    pat = b"\x00" + table_section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
    pmt = b"\x00" + table_section(
        0x02, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_PRIVATE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])
    )
    out, counter, tables = [], 0, 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        unit, access = payload[at : at + UNIT], i % ACCESS_EVERY == 0
        if access:
            for pid, section in ((PAT_PID, pat), (PMT_PID, pmt)):
                body = section + b"\xff" * (PACKET - 4 - len(section))
                out.append(_packet(pid, True, tables, b"", body))
            tables += 1
        header = bytes([0, 0, 1, STREAM_ID]) + (8 + len(unit)).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + _stamp(i * TICKS)
        data = header + unit
        field_ = b"\x50" + _clock(i * TICKS) if access else b""
        room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
        out.append(_packet(DATA_PID, True, counter, field_, data[:room]))
        counter += 1
        full = max(0, len(data) - room) // (PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(data, np.uint8, full * (PACKET - 4), room).reshape(full, PACKET - 4)
            out.append(block.tobytes())
            counter += full
        rest = data[room + full * (PACKET - 4) :]
        if rest:
            out.append(_packet(DATA_PID, False, counter, b"", rest))
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    #: Time stamp, offset in the payload and whether it is a random-access point, per unit.
    units: list[tuple[int, int, bool]] = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0
    errors: int = 0

    def feature(self) -> str:
        """Programs, streams, packets, units, access points, last time stamp and faults as text."""
        access = sum(a for _, _, a in self.units)
        last = max((t for t, _, _ in self.units), default=0)
        return (
            f"programs={len(self.programs)};streams={len(self.streams)};packets={self.packets};units={len(self.units)};"
            f"access={access};last_pts={last};discontinuities={self.discontinuities};errors={self.errors}"
        )


def _sections(packets: list[tuple[bool, bytes]]) -> tuple[list[bytes], int]:
    """Sound sections of a table's packets (unit start, payload) in order, and the number of broken ones.

    A section runs on over as many packets as its length asks for. In a packet
    that starts one, the pointer tells where; what lies before belongs to the
    section before.
    """
    kept, broken = [], 0
    data: bytes | None = None

    def close() -> None:
        nonlocal broken
        at = 0
        while data and at < len(data) and data[at] != 0xFF:
            end = at + 3 + ((data[at + 1] & 0x0F) << 8 | data[at + 2]) if at + 3 <= len(data) else len(data) + 1
            if end > len(data) or end - at < 12 or section_crc(data[at:end]):
                broken += 1
                break
            kept.append(data[at:end])
            at = end

    for begins, payload in packets:
        if begins:
            pointer = payload[0] if payload else 0
            data = data + payload[1 : 1 + pointer] if data is not None else None
            close()
            if 1 + pointer > len(payload):
                broken += 1
            data = payload[1 + pointer :]
        elif data is not None:
            data += payload
    close()
    return kept, broken


def demux(media: bytes) -> Stream:
    """Read a transport stream; faults are counted, not raised.

    A packet may be sent twice in a row, which is lawful and read once; a packet
    that announces a discontinuity may carry any counter.
    """
    found = Stream(packets=len(media) // PACKET, errors=int(len(media) % PACKET > 0))
    if not found.packets:
        return found
    grid = np.frombuffer(media, np.uint8, found.packets * PACKET).reshape(-1, PACKET)
    found.errors += int((grid[:, 0] != SYNC).sum())
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    control = grid[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + grid[:, 4].astype(np.int32), 4)
    starts = (grid[:, 1] & 0x40) > 0
    access = ((control & 2) > 0) & (grid[:, 4] > 0) & ((grid[:, 5] & 0x40) > 0)
    sound = (grid[:, 0] == SYNC) & ((control & 1) > 0) & (begin < PACKET)

    announced = ((control & 2) > 0) & (grid[:, 4] > 0) & ((grid[:, 5] & 0x80) > 0)

    def once(rows: np.ndarray) -> np.ndarray:
        """Rows of a stream without packets that repeat the one before."""
        if len(rows) < 2:
            return rows
        counters = grid[rows, 3] & 15
        again = np.concatenate([[False], counters[1:] == counters[:-1]])
        for i in np.flatnonzero(again):
            again[i] = not again[i - 1] and bool((grid[rows[i]] == grid[rows[i - 1]]).all())
        return rows[~again]

    def sections(of: int) -> list[bytes]:
        packets = [(bool(starts[i]), grid[i, int(begin[i]) :].tobytes()) for i in once(np.flatnonzero(sound & (pid == of))).tolist()]
        kept, broken = _sections(packets)
        found.errors += broken
        return kept

    for s in sections(PAT_PID):
        for at in range(8, len(s) - 4, 4):
            if number := s[at] << 8 | s[at + 1]:
                found.programs[number] = (s[at + 2] & 0x1F) << 8 | s[at + 3]
    for table in sorted(set(found.programs.values())):
        for s in sections(table):
            if len(s) < 16:
                found.errors += 1
                continue
            at = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                found.streams[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
    parts: list[bytes] = []
    size = 0
    for own in sorted(found.streams):
        rows = once(np.flatnonzero(sound & (pid == own)))
        counters = grid[rows, 3] & 15
        found.discontinuities += int((((np.diff(counters.astype(np.int8)) - 1) % 16 != 0) & ~announced[rows[1:]]).sum())
        edges = np.flatnonzero(starts[rows])
        for a, b in zip(edges, [*edges[1:], len(rows)]):
            data = b"".join([media[PACKET * r + o : PACKET * (r + 1)] for r, o in zip(rows[a:b].tolist(), begin[rows[a:b]].tolist())])
            if data[:3] != b"\x00\x00\x01" or len(data) < 9:
                found.errors += 1
                continue
            length, head = data[4] << 8 | data[5], 9 + data[8]
            time = 0
            if data[7] & 0x80 and (len(data) < 14 or data[8] < 5):
                found.errors += 1
            elif data[7] & 0x80:
                d = data[9:14]
                time = (d[0] & 0x0E) << 29 | d[1] << 22 | (d[2] & 0xFE) << 14 | d[3] << 7 | d[4] >> 1
            unit = data[head : 6 + length] if length else data[head:]
            found.errors += int(bool(length) and len(data) < 6 + length)
            found.units.append((time, size, bool(access[rows[a]])))
            parts.append(unit)
            size += len(unit)
    found.payload = b"".join(parts)
    return found


def padded(text: str) -> bytes:
    """UTF-8 bytes of a text, filled with spaces to a positive multiple of ``BLOCK``."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media (a transport stream of the padded text).

    A null text is empty; an empty one is a block of spaces; repeated rows have
    equal media; texts are stored whole. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(df: DataFrame) -> DataFrame:
    """Read the column ``media`` of (doc_id, n_bytes, media): adds payload, units and feature.

    A null or broken stream gives what can be read and counts the faults.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    unit = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                read = [demux(m or b"") for m in batch.column(2).to_pylist()]
                units = [[{"pts": t, "offset": o, "random_access": a} for t, o, a in s.units] for s in read]
                columns = [pa.array([s.payload for s in read], pa.binary()), pa.array(units, unit), pa.array([s.feature() for s in read], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["doc_id", "n_bytes", "media", "payload", "units", "feature"])

    schema = f"doc_id {kind}, n_bytes long, media binary, payload binary, units array<struct<pts: long, offset: long, random_access: boolean>>, feature string"
    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def digests(read: DataFrame) -> DataFrame:
    """Sizes and digests of read media."""
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
